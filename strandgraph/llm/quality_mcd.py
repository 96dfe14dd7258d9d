"""Quality rules: word statistics, base limits, and robust multivariate outliers by minimum covariance determinant.

Word statistics are DataFrame functions over whole texts. Texts that pass the base limits give a vector of five
transformed statistics in fixed point. For each language and source, the covariance of least determinant over three
quarters of the vectors is sought: from three deterministic starts (medians with median deviations; covariance of the
vectors' hyperbolic tangents; covariance of their directions), concentration steps take the three quarters that lie closest
under the present estimate, and these vectors' mean and covariance as the next. After EXPLORE steps the start of least
determinant goes on until no group's estimate changes any more (MOST_STEPS at most). Covariances are regularised towards a
fixed diagonal (FLOORS squared), as most statistics of most texts are zero and a plain determinant would be; a
concentration step never raises the determinant of such an estimate either.

A text is rejected if its squared Mahalanobis distance under that estimate, scaled so that the median distance is that of a
normal vector, exceeds CUT. All sums are of integers, so results do not depend on how rows are dealt; quantiles are exact
over a bounded number of distinct fixed-point values, so a group of any size is combined before the shuffle.

Languages and sources of fewer than MIN_GROUP vectors are pooled by language, and such pools once more over all
languages; a last pool of fewer than MIN_POOL rejects nothing.

Defined results: null, empty and wordless texts have zeros and fail the base limits; null lang or source count as the
empty string; repeated rows are judged each for itself, alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3

MIN_GROUP = 200
MIN_POOL = 50
#: Share of vectors in the concentrated subset, in percent; concentration steps of every start, and of the best one.
SUBSET_PERCENT = 75
STARTS, EXPLORE, MOST_STEPS = 3, 2, 10
#: Fixed point of the starts' transformed deviations.
START_SCALE = 1_000
#: Fixed point of vectors and of logarithms of distances.
SCALE = 10_000
DISTANCE_SCALE = 1_000
#: Squared Mahalanobis distance beyond which a vector is rejected: the 1 - 1e-6 quantile of chi-squared with five degrees
#: of freedom, so that one normal vector in a million is.
CUT = 35.888187
#: Fixed value: the median of chi-squared with five degrees of freedom.
CHI2_MEDIAN = 4.351460191095526
#: Statistics, and the least standard deviation each is credited with: many are zero for most texts of a group.
VECTOR = ["word_length", "symbols", "dup_lines", "repeats", "length"]
FLOORS = [0.05, 0.5, 0.5, 0.5, 0.5]

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE_CLASS}+"))


#: Words in three-word windows found twice or more. Windows are hashed; hash and place are packed into one long each and
#: sorted, so equal windows are neighbours. Packing drops as many hash bits as places need: where two unlike windows then
#: look alike, the text is done again with whole hashes. Names: h hashes by place, b bits of a place, s packed and
#: sorted, d those packed ones that repeat.
REPEAT_SQL = """
CASE WHEN size({words}) < 4 THEN 0L ELSE
transform(array(transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))), h ->
 transform(array(length(bin(size(h)))), b ->
  transform(array(sort_array(transform(h, (x, i) -> shiftleft(x, b) | i))), s ->
   transform(array(filter(s, (x, i) -> (i > 0 AND shiftright(x, b) = shiftright(s[i - 1], b)) OR (i + 1 < size(s) AND shiftright(x, b) = shiftright(s[i + 1], b)))), d ->
    CASE WHEN size(d) = 0 THEN 0L
         ELSE aggregate(
          sort_array(
           CASE WHEN exists(sequence(1, size(d) - 1), i -> shiftright(d[i], b) = shiftright(d[i - 1], b) AND h[int(d[i] & (shiftleft(1L, b) - 1))] != h[int(d[i - 1] & (shiftleft(1L, b) - 1))])
                THEN transform(filter(transform(h, (x, i) -> named_struct('x', x, 'i', i)), e -> size(filter(h, y -> y = e.x)) > 1), e -> bigint(e.i))
                ELSE transform(d, x -> x & (shiftleft(1L, b) - 1)) END),
          named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n) END
)[0])[0])[0])[0] END
"""


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    counted = let(
        word_array(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            w.alias("w"),
        ),
    )
    dup = let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    out = docs.withColumn("counted", counted).withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")).withColumn("n_dup_lines", dup)
    out = out.withColumn("n_repeat_words", F.expr("transform(array(counted.w), words -> " + REPEAT_SQL.format(words="words") + ")[0]"))
    return out.select(
        *(f"`{c}`" for c in docs.columns),
        "counted.n_words",
        "counted.word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.expr(f"counted.n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * counted.n_words").alias("base_failed"),
    )


def fixed(value: str) -> str:
    return f"CAST(round({SCALE} * ({value})) AS BIGINT)"


#: The transforms, as SQL of Spark and DuckDB alike; a row that failed the base limits has none. A share's factor says what
#: share is about one unit from none: a thousandth of symbols, a line repeated in a hundred words, a tenth of repeated
#: words. Prose has a line or a phrase twice now and then, but hardly a run of signs.
TRANSFORMS = [
    fixed("ln(CAST(word_chars AS DOUBLE) / n_words)"),
    fixed("ln(1 + 1000 * CAST(n_symbols AS DOUBLE) / word_chars)"),
    fixed("ln(1 + 100 * CAST(n_dup_lines AS DOUBLE) / n_words)"),
    fixed("ln(1 + 10 * CAST(n_repeat_words AS DOUBLE) / n_words)"),
    fixed("ln(CAST(n_words AS DOUBLE))"),
]
P = len(VECTOR)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def cholesky_sql() -> list[tuple[str, str]]:
    """Lower factor l_i_j of the covariance c_i_j, one expression after another."""
    out = []
    for i, j in PAIRS:
        inner = " - ".join([f"c_{i}_{j}", *(f"l_{i}_{k} * l_{j}_{k}" for k in range(j))])
        out.append((f"l_{i}_{j}", f"sqrt(greatest({inner}, 1e-9))" if i == j else f"({inner}) / l_{j}_{j}"))
    return out


def distance_sql() -> list[tuple[str, str]]:
    """z = L^-1 (x - m) by forward substitution, then the squared distance d2."""
    out = [(f"z_{i}", "(" + " - ".join([f"(x_{i} / {float(SCALE)} - m_{i})", *(f"l_{i}_{k} * z_{k}" for k in range(i))]) + f") / l_{i}_{i}") for i in range(P)]
    return [*out, ("d2", " + ".join(f"z_{i} * z_{i}" for i in range(P)))]


#: Logarithm of a distance in fixed point: few distinct values, whatever the number of rows.
BIN_SQL = f"CAST(round({DISTANCE_SCALE} * ln(1 + d2)) AS BIGINT)"


def chain(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """df with the steps' columns; a step may name those before it, which one select resolves: the driver analyses one plan for all."""
    return df.select("*", *(F.expr(expression).alias(name) for name, expression in steps))


#: Languages and sources up to which a table of groups is broadcast; with more, it is joined by shuffles.
FEW_GROUPS = 10_000


def is_small(table: DataFrame) -> bool:
    return table.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def few(table: DataFrame, small: bool) -> DataFrame:
    """A table of groups, to be broadcast if these were counted to be few: then no group's rows are gathered."""
    return F.broadcast(table) if small else table


def quantile(values: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """keys, the quantile of the whole numbers in `bin`, and members: equal ones are counted first, in each task before the
    shuffle."""
    return values.groupBy(*keys, "bin").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.expr(f"percentile(bin, {share}, n)").alias(name), F.sum("n").alias("members"))


def grouped(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """vectors with the key of the group that judges them (language and source, else the language's pool, else all), and
    whether languages and sources are few."""
    sizes = vectors.groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    pools = sizes.where(small).groupBy("lang_key").agg(F.sum("n").alias("pool"))
    keys = sizes.join(pools, "lang_key", "left").select(
        "lang_key",
        "source_key",
        F.when(~small, F.to_json(F.struct("lang_key", "source_key"))).when(F.col("pool") >= MIN_GROUP, F.to_json(F.struct("lang_key"))).otherwise("{}").alias("group_key"),
    )
    keys = stage(keys, "groups")
    small = is_small(keys)
    return vectors.join(few(keys, small), ["lang_key", "source_key"]), small


#: A vector's deviations from the medians in median deviations, and the two starts' transforms of them.
Z_SQL = [f"((x_{i} - med_{i}) / {float(SCALE)} / s_{i})" for i in range(P)]
LENGTH_SQL = "sqrt(greatest(" + " + ".join(f"{z} * {z}" for z in Z_SQL) + ", 1e-9))"
START_SQL = {1: [f"CAST(round({START_SCALE} * tanh({z})) AS BIGINT)" for z in Z_SQL], 2: [f"CAST(round({START_SCALE} * {z} / {LENGTH_SQL}) AS BIGINT)" for z in Z_SQL]}
#: Logarithm of a covariance's determinant, of its factor; two that differ in rounding only are equal.
LOGDET_SQL = "round(2 * (" + " + ".join(f"ln(l_{i}_{i})" for i in range(P)) + "), 6)"


def start_columns(start: int) -> list[tuple[str, str]]:
    """Mean and covariance of a start from medians med_i, spreads s_i, and sums a_i_j (tangents) and b_i_j (directions)."""
    out = [(f"m_{i}", f"med_{i} / {float(SCALE)}") for i in range(P)]
    for i, j in PAIRS:
        if start:
            value = f"s_{i} * s_{j} * {1 if start == 1 else P} * CAST({'ab'[start - 1]}_{i}_{j} AS DOUBLE) / n / {float(START_SCALE) ** 2}"
            out.append((f"c_{i}_{j}", f"{value} + {FLOORS[i] ** 2}" if i == j else value))
        else:
            out.append((f"c_{i}_{j}", f"s_{i} * s_{i}" if i == j else "CAST(0 AS DOUBLE)"))
    return out


SPREAD_SQL = [f"greatest(1.4826 * mad_{i} / {float(SCALE)}, {FLOORS[i]})" for i in range(P)]


def first_estimates(vectors: DataFrame, small: bool) -> DataFrame:
    """Each group's starts: group_key, start, m_i, c_i_j, l_i_j."""
    medians = vectors.groupBy("group_key").agg(*(F.expr(f"percentile(x_{i}, 0.5)").alias(f"med_{i}") for i in range(P)))
    spread = vectors.join(few(stage(medians, "medians"), small), "group_key").groupBy("group_key").agg(*(F.expr(f"percentile(abs(x_{i} - med_{i}), 0.5)").alias(f"mad_{i}") for i in range(P)), *(F.first(f"med_{i}").alias(f"med_{i}") for i in range(P)))
    spread = stage(spread.select("group_key", *(f"med_{i}" for i in range(P)), *(F.expr(e).alias(f"s_{i}") for i, e in enumerate(SPREAD_SQL))), "spreads")
    moved = vectors.join(few(spread, small), "group_key").select("group_key", *(F.expr(e).alias(f"{'ab'[k - 1]}_{i}") for k, given in START_SQL.items() for i, e in enumerate(given)))
    sums = moved.groupBy("group_key").agg(F.count("*").alias("n"), *(F.sum(F.expr(f"{c}_{i} * {c}_{j}")).alias(f"{c}_{i}_{j}") for c in "ab" for i, j in PAIRS))
    told = stage(spread.join(sums, "group_key"), "starts")
    return reduce(DataFrame.unionByName, [chain(told.select("group_key", F.lit(k).alias("start"), *(F.expr(e).alias(n) for n, e in start_columns(k))), cholesky_sql()) for k in range(STARTS)])


def concentrate(vectors: DataFrame, estimate: DataFrame, small: bool) -> DataFrame:
    """One concentration step of each group's estimates: mean and covariance of the closest vectors under each."""
    keys = ["group_key", "start"]
    binned = chain(vectors.join(few(estimate, small), "group_key"), distance_sql()).withColumn("bin", F.expr(BIN_SQL)).select(*keys, "bin", *(f"x_{i}" for i in range(P)))
    limits = quantile(binned, keys, SUBSET_PERCENT / 100, "limit_bin").drop("members")
    sums = [F.count("*").alias("n"), *(F.sum(F.expr(f"CAST(x_{i} AS DECIMAL(18,0))")).alias(f"s_{i}") for i in range(P)), *(F.sum(F.expr(f"CAST(x_{i} * x_{j} AS DECIMAL(19,0))")).alias(f"s_{i}_{j}") for i, j in PAIRS)]
    totals = binned.join(few(stage(limits, "limits"), small), keys).where("bin <= limit_bin").groupBy(*keys).agg(*sums)
    mean = {i: f"(CAST(s_{i} AS DOUBLE) / n)" for i in range(P)}
    columns = [F.expr(f"{mean[i]} / {float(SCALE)}").alias(f"m_{i}") for i in range(P)]
    for i, j in PAIRS:
        value = f"(CAST(s_{i}_{j} AS DOUBLE) / n - {mean[i]} * {mean[j]}) / {float(SCALE) ** 2}"
        columns.append(F.expr(f"{value} + {FLOORS[i] ** 2}" if i == j else value).alias(f"c_{i}_{j}"))
    return chain(totals.select(*keys, *columns), cholesky_sql())


def least_determinant(vectors: DataFrame, small: bool = False) -> DataFrame:
    """Each group's estimate (group_key, start, m_i, c_i_j, l_i_j), written."""
    estimate = stage(first_estimates(vectors, small), "estimate")
    for _ in range(EXPLORE):
        estimate = stage(concentrate(vectors, estimate, small), "estimate")
    rest = [c for c in estimate.columns if c not in ("group_key", "start")]
    best = estimate.groupBy("group_key").agg(F.min(F.struct(F.expr(LOGDET_SQL).alias("logdet"), "start", *rest)).alias("best"))
    estimate = stage(best.select("group_key", "best.start", *(f"best.{c}" for c in rest)), "estimate")
    for _ in range(MOST_STEPS):
        before = few(estimate.select("group_key", F.struct(*rest).alias("before")), small)
        found = stage(concentrate(vectors, estimate, small).join(before, "group_key").withColumn("moved", F.struct(*rest) != F.col("before")).drop("before"), "estimate")
        estimate = found.drop("moved")
        if not found.where("moved").take(1):
            break
    return estimate


def models(rows: DataFrame) -> tuple[DataFrame, bool]:
    """lang_key, source_key and the model that judges them, written, and whether these rows are few. rows: lang_key, source_key, base_failed, x_i."""
    keyed, small = grouped(rows.where("NOT base_failed").select("lang_key", "source_key", *(f"x_{i}" for i in range(P))))
    estimate = least_determinant(keyed, small)
    middle = quantile(chain(keyed.join(few(estimate, small), "group_key"), distance_sql()).withColumn("bin", F.expr(BIN_SQL)), ["group_key"], 0.5, "middle")
    pairs = keyed.select("group_key", "lang_key", "source_key").distinct()
    return stage(pairs.join(estimate, "group_key").join(middle, "group_key").withColumn("factor", F.expr(f"greatest(exp(middle / {float(DISTANCE_SCALE)}) - 1, 1e-9) / {CHI2_MEDIAN}")), "models"), small


def judged(docs: DataFrame, carried: list[Column], text: str, lang: str, source: str) -> DataFrame:
    """carried (of names that no statistic has), the statistics, kept and distance. What is carried is written beside the
    statistics once and is not shuffled, unless there are more than FEW_GROUPS languages and sources."""
    slim = docs.select(*carried, F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang_key"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source_key"))
    counted = with_statistics(slim).drop("text")
    rows = stage(chain(counted, [(f"x_{i}", f"CASE WHEN NOT base_failed THEN {TRANSFORMS[i]} END") for i in range(P)]), "statistics")
    found = chain(rows.join(few(*models(rows)), ["lang_key", "source_key"], "left"), distance_sql()).withColumn("distance", F.expr("CASE WHEN NOT base_failed THEN d2 / greatest(factor, 1.0) END"))
    kept = F.expr(f"NOT base_failed AND (members < {MIN_POOL} OR distance <= {CUT})")
    return found.withColumn("kept", kept)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, kept, distance."""
    found = judged(docs, [F.col(f"`{doc_id}`").alias("doc_id")], text, lang, source)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def digest(found: DataFrame) -> DataFrame:
    return found.drop("distance")


def keep_good(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, columns as they were."""
    found = judged(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")], text, lang, source)
    return found.where("kept").select("row.*")
