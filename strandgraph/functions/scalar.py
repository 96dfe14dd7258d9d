"""Text, date, identifier and JSON functions, Column in and Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes plain spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def present(*columns: Column) -> Column:
    """Whether all are neither null nor empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(c != "", F.lit(False))
    return out


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def slug(c: Column, words: int = 12) -> Column:
    """Lower case, & spelled out, / , ( ) . as spaces, apostrophes dropped, the first words joined by underscores."""
    plain = F.translate(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "/,().'", "     ")
    return F.array_join(F.slice(F.filter(F.split(plain, WHITE), lambda w: w != ""), 1, words), "_")


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, yyyy-MM or yyyy, padded or not, else null. Spark's year pattern takes other widths, so shapes are checked."""
    s = strip(c)
    as_day = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))
    as_month = F.when(s.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(s, F.lit("-1")), "yyyy-M-d"))
    as_year = F.when(s.rlike(r"^\d{4}$"), F.try_to_date(F.concat(s, F.lit("-1-1")), "yyyy-M-d"))
    return F.coalesce(as_day, as_month, as_year)


def phase_max(c: Column) -> Column:
    """The highest phase named, 4 down to 1 (early phases count as 1), else null."""
    upper = F.upper(c)
    out = F.when(upper.contains("PHASE4"), 4)
    for n in (3, 2, 1):
        out = out.when(upper.contains(f"PHASE{n}"), n)
    return out.when(upper.contains("EARLY"), 1)


def phase_join(c: Column) -> Column:
    """An array of phases as comma-joined text; empty as null."""
    return blank_to_null(F.trim(F.array_join(c, ",")))


def phase_text(c: Column) -> Column:
    """phase_join of JSON text: a list, or plain text as it is."""
    return F.when(F.ltrim(c).startswith("["), phase_join(F.from_json(c, "array<string>"))).otherwise(blank_to_null(F.trim(c)))


def org_key(c: Column) -> Column:
    return F.concat(F.lit("ORG:"), F.substring(F.regexp_replace(F.upper(c), WHITE, "_"), 1, 120))


def cik_pad(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def cik_of(response: Column) -> Column:
    """The padded CIK in a company search response, else null."""
    found = F.regexp_extract(response, r"<CIK>(\d+)</CIK>", 1)
    return F.when(found != "", cik_pad(found))


def uri_tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def edge_props(score: Column, mesh_id: Column) -> Column:
    return F.to_json(F.struct(score.alias("score"), mesh_id.alias("mesh_id")))


def json_score(props: Column) -> Column:
    return F.expr("try_cast(get_json_object(props, '$.score') AS double)") if isinstance(props, str) else F.get_json_object(props, "$.score").try_cast("double")


def json_merge(left: Column, right: Column) -> Column:
    """Shallow merge of JSON objects of scalars, right wins, a null on the right included; null counts as {}."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind)) for c in (left, right))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def edge_width(score: Column) -> Column:
    return F.greatest(F.lit(0.5), 5 * score)


def edge_opacity(score: Column) -> Column:
    return F.greatest(F.lit(0.2), score)


#: Colour, shape and size of nodes by kind; other kinds have the last.
NODE_STYLES = {"disease": ("#e74c3c", "diamond", 35), "target": ("#3498db", "dot", 20), "drug": ("#2ecc71", "box", 30), "patent": ("#9b59b6", "star", 25), "company": ("#f39c12", "box", 25)}
OTHER_STYLE = ("#95a5a6", "dot", 20)


def node_style(kind: Column) -> Column:
    """A struct of colour, shape and size."""
    one = lambda style: F.struct(F.lit(style[0]).alias("color"), F.lit(style[1]).alias("shape"), F.lit(style[2]).alias("size"))
    out = None
    for name, style in NODE_STYLES.items():
        out = F.when(kind == name, one(style)) if out is None else out.when(kind == name, one(style))
    return out.otherwise(one(OTHER_STYLE))


def like_pattern(q: str) -> str:
    """%q% for ILIKE with backslash as escape: a backslash before an ordinary character is dropped, % and _ stay wildcards,
    and a lone one at the end makes the closing % literal."""
    out, i = [], 0
    while i < len(q):
        if q[i] == "\\" and i + 1 < len(q):
            out.append(q[i : i + 2] if q[i + 1] in "%_\\" else q[i + 1])
            i += 2
        else:
            out.append(q[i])
            i += 1
    return "%" + "".join(out) + "%"
