"""Each operator against brute force on a corpus of odd rows, and on an empty table."""

import base64
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandgraph.llm import bwt_dedup, bwt_merge, bytewords, components, decontam, html_crf, jaccard_join, license_rules, packing, quality_mcd, shard_table, warc_bundles, zstd_quality

from . import brute

WINTER = "It was the third winter in the valley, and the river had frozen as far as the mill."
YEAR = "Nobody in the village could remember a colder year, although the older people said that they could."
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def multiset(rows):
    return sorted(map(repr, rows))


# 1: quality rules


def test_quality_statistics(docs, corpus, none):
    found = quality_mcd.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert multiset(tuple(r)[:7] for r in found) == multiset((r[0], *brute.statistics(r[1])) for r in corpus)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_mcd.judge(none).count() == 0


def test_quality_rejects_far_vectors_only(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 3 + int(rng.integers(5)))) for _ in range(n))
    rows = [(i, text(int(rng.integers(80, 300))), "en", f"s{i % 2}") for i in range(500)]
    rows += [(1000 + i, " ".join(w + "###$$$" for w in text(150).split()), "en", "s0") for i in range(5)]
    found = {r["doc_id"]: r["kept"] for r in quality_mcd.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(not found[i] for i in range(500)) <= 2
    assert not any(found[1000 + i] for i in range(5))


def regularised(near):
    return near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(np.array(quality_mcd.FLOORS) ** 2)


def logdet(cov):
    return np.linalg.slogdet(cov)[1]


def vector_table(spark, groups):
    rows = [(name, *map(int, r)) for name, x in groups.items() for r in x]
    return spark.createDataFrame(rows, "group_key string, " + ", ".join(f"x_{i} long" for i in range(5)))


def covariance(row):
    out = np.zeros((5, 5))
    for i, j in quality_mcd.PAIRS:
        out[i, j] = out[j, i] = row[f"c_{i}_{j}"]
    return out


def test_mcd_against_numpy(spark):
    """Concentration to a fixed point from three starts, and the least determinant of them."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(600, 5)) @ rng.normal(size=(5, 5)) * 4000 + 20000).astype(np.int64)
    x[:30] += 60_000
    row = quality_mcd.least_determinant(vector_table(spark, {"g": x})).first()
    scale, floors = quality_mcd.SCALE, np.array(quality_mcd.FLOORS)
    y = x / scale
    med = np.median(y, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(y - med), axis=0), floors)
    z = (y - med) / spread
    tangents, directions = np.tanh(z), z / np.sqrt((z * z).sum(axis=1, keepdims=True))
    starts = [np.diag(spread**2), np.outer(spread, spread) * (tangents.T @ tangents) / 600 + np.diag(floors**2), np.outer(spread, spread) * 5 * (directions.T @ directions) / 600 + np.diag(floors**2)]

    def step(mean, cov):
        d = np.einsum("ij,jk,ik->i", y - mean, np.linalg.inv(cov), y - mean)
        bins = np.round(quality_mcd.DISTANCE_SCALE * np.log1p(d))
        return regularised(y[bins <= np.quantile(bins, 0.75)])

    found = []
    for cov in starts:
        mean = med
        for _ in range(quality_mcd.EXPLORE):
            mean, cov = step(mean, cov)
        found.append((round(logdet(cov), 6), len(found), mean, cov))
    _, start, mean, cov = min(found, key=lambda f: f[:2])
    for _ in range(quality_mcd.MOST_STEPS):
        mean, cov = step(mean, cov)
    assert row["start"] == start
    assert np.allclose([row[f"m_{i}"] for i in range(5)], mean, rtol=1e-6)
    assert np.allclose(covariance(row), cov, rtol=1e-4)


def test_mcd_against_all_subsets(spark):
    """On small groups the subset of least determinant, sought among all, is found."""
    rng = np.random.default_rng(3)
    groups = {}
    for k in range(4):
        x = rng.normal(size=(12, 5)) * 8000 + 30_000
        x[:3] = 30_000 + 60_000 * rng.normal(size=(3, 5))
        groups[f"g{k}"] = x.astype(np.int64)
    for row in quality_mcd.least_determinant(vector_table(spark, groups)).collect():
        y = groups[row["group_key"]] / quality_mcd.SCALE
        best = min(logdet(regularised(y[list(c)])[1]) for c in itertools.combinations(range(12), 9))
        assert math.isclose(logdet(covariance(row)), best, rel_tol=1e-6)


# 2: HTML


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><nav><a href=1>Home</a> <a href=2>News</a></nav><article><h1>A title</h1><p>First <b>par</b>agraph&nbsp;&amp; more.<br>Next\n line.</p><div class='ad'>Buy now.</div><p>Last one.</p></article><div id=comments><p>I do not agree with that at all.</p></div><footer>&copy; 2020 Us</footer>", "A title First paragraph & more. Next line. Last one."),
        ("<script>var t='<p>no</p>'</script><main><p>Kept text of the page, long enough to count.</p></main><form><label>Name</label><button>Go</button></form>", "Kept text of the page, long enough to count."),
        ("<article><p>Cut off in the mid", "Cut off in the mid"),
        ("", ""),
        ("<div></div>", ""),
        # Written by hand, unlike any page that the field is trained on: stray quotes, odd attributes, and names of states.
        (f"<article><p title=don't>{WINTER}</p><p>It's me again, said the miller.</p></article>", f"{WINTER} It's me again, said the miller."),
        (f"<article data-x=it's><h1>The mill</h1><p>{WINTER}</p></article><footer>(c) 2020 it's ours</footer>", f"The mill {WINTER}"),
        (f"<div class=comments-disabled><article><h1>The mill</h1><p>{WINTER}</p><p>{YEAR}</p></article></div>", f"The mill {WINTER} {YEAR}"),
        (f'<article><p data-a="a > b" class="x">{WINTER}</p></article>', WINTER),
        (f"<article><p class=\"a\"id='b'>{WINTER}</p></article>", WINTER),
        (f"<article><svg class=i /><p>{WINTER}</p></article>", WINTER),
        (f"<div class='wrap has-sidebar no-nav'><div class=post><p>{WINTER}</p><p>{YEAR}</p></div><div class=sidebar><h3>Links</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div></div>", f"{WINTER} {YEAR}"),
        (f"<html><head><title>T</title><script>if (a<b) x='</p>'</script></head><body><header><h1>Site</h1><nav><a href=/>Home</a><a href=/b>Blog</a></nav></header><main><article><h1>The frozen river</h1><p>{WINTER}</p><aside class=advert>Buy skates now!</aside><p>{YEAR}</p></article><section id=comments><h2>2 comments</h2><p>Great story, thank you for that.</p></section></main><footer><p>Copyright the valley press.</p></footer></body></html>", f"The frozen river {WINTER} {YEAR}"),
        (f"<div id=content><table><tr><td>Year<td>Ice</tr><tr><td>1890<td>12 cm</table><p>{WINTER}</p></div><div class=footer>All rights reserved.</div>", f"Year Ice 1890 12 cm {WINTER}"),
        (f"<div id=cookie-banner><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class=entry><p>{WINTER}</p></div>", WINTER),
        (f"<ARTICLE><P CLASS=Lead>{WINTER}</P></ARTICLE><ASIDE><P>Read more of our winter stories.</P></ASIDE>", WINTER),
        (f"<p>{WINTER}<p>{YEAR}", f"{WINTER} {YEAR}"),
        ("<article>" + f"<p>{WINTER}</p>" * 20_000 + "</article>", " ".join([WINTER] * 20_000)),
    ],
)
def test_html_pages(page, text):
    assert html_crf.extract(html_crf.trained(), page) == text


def test_html_held_out_accuracy():
    maker, right, total = html_crf.Maker(12345), 0, 0
    for _ in range(150):
        found, labels = maker.page()
        got = html_crf.trained().decode(found)
        right, total = right + sum(a == b for a, b in zip(got, labels)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_path():
    field, maker = html_crf.trained(), html_crf.Maker(7)
    for _ in range(20):
        found = maker.page()[0][:8]
        emit = [[field.weights[y, html_crf.active(b)].sum() for y in (0, 1)] for b in found]
        score = lambda ys: field.first[ys[0]] + sum(e[y] for e, y in zip(emit, ys)) + sum(field.transitions[a, b] for a, b in zip(ys, ys[1:]))
        paths = [[n >> i & 1 for i in range(len(found))] for n in range(1 << len(found))]
        if found:
            assert math.isclose(score(field.decode(found)), max(map(score, paths)))


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>Some text here, of a page.</p>", "x"), (2, "u", "<p>Some text here, of a page.</p>", "x")], "page_id long, url string, html string, n_chars string")
    rows = html_crf.main_text(pages, keep=["page_id", "url"]).collect()
    assert multiset(map(tuple, rows)) == multiset([(1, None, "", 0), (2, "u", "Some text here, of a page.", 26), (2, "u", "Some text here, of a page.", 26)])
    assert html_crf.main_text(pages.limit(0), keep=["page_id"]).count() == 0


# 3: sharding


def test_shard_table_fill_and_move():
    names = shard_table.shard_names(7)
    table = shard_table.fill(names, 1009)
    sizes = np.bincount(table)
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    order = [[(shard_table.hash60(f"start:{n}") + i * (shard_table.hash60(f"step:{n}") % 1008 + 1)) % 1009 for i in range(1009)] for n in names]
    slow = {}
    while len(slow) < 1009:
        for k, preferred in enumerate(order):
            free = next((s for s in preferred if s not in slow), None)
            if free is not None:
                slow[free] = k
    assert table == [slow[i] for i in range(1009)]
    fewer = shard_table.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 1009 * 0.2
    with pytest.raises(ValueError):
        shard_table.fill(names, 1000)


def test_placement(spark, docs, none):
    placed = shard_table.place(docs.withColumn("slot", F.lit(1)), "doc_id", names=shard_table.shard_names(5), size=101)
    rows = placed.collect()
    assert len(rows) == docs.count() and "_slot" in placed.columns
    table = shard_table.fill(shard_table.shard_names(5), 101)
    assert all(r["shard"] == table[shard_table.hash60("null" if r["doc_id"] is None else str(r["doc_id"])) % 101] for r in rows)
    assert shard_table.place(none, "doc_id").count() == 0


# 4: quality classifier


def test_quality_classifier(spark, docs, none):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioudrtnsl"), 4 + int(rng.integers(4))))
    good = lambda: " ".join(word() for _ in range(80)) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(80))
    rows = [(i, good() if i % 3 else bad()) for i in range(900)] + [(2000, None), (2001, ""), (None, good())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(900)] + [(None, 1, 0), (5000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = zstd_quality.fit(table, labels)
    found = zstd_quality.digest(zstd_quality.score(table, model, keep=["doc_id"])).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] < 900]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert np.mean([r["predicted"] == bool(r["doc_id"] % 3) for r in held]) > 0.95
    flipped = labels.withColumn("quality", F.when(zstd_quality.fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert zstd_quality.fit(table, flipped) == model
    clashing = zstd_quality.score(table.withColumn("Score", F.lit("x")), model)
    assert clashing.columns == ["doc_id", "text", "Score", "_score"]
    tied = zstd_quality.digest(zstd_quality.score(table.where("doc_id < 20"), zstd_quality.Model(b"", b"", 0.0, 0.0), keep=["doc_id"])).collect()
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in tied)
    long = lambda make: " ".join(make() for _ in range(500)).encode()
    assert zstd_quality.Scorer(model).score(long(good)) > zstd_quality.Scorer(model).score(long(bad)) + 0.1
    empty = zstd_quality.fit(none.select("doc_id", "text"), labels)
    assert zstd_quality.score(none.select("doc_id", "text"), empty, keep=["doc_id"]).count() == 0


# 5: licences


def test_license_base(spark, docs, corpus, none):
    texts = [r[1] for r in corpus] + ["CC-BY cc by, cc  BY", "GNU General Public License v3. All rights reserved", "xcc by general public licenses", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC-SA 4.0"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in license_rules.digest(license_rules.scan_licences(table, keep=["doc_id"])).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i])[1:6] == brute.base_places(t, license_rules.BASE)
        assert set(filter(None, rows[i]["base_labels"].split(","))) <= set(rows[i]["labels"].split(","))
    n = len(corpus)
    assert rows[n + 1]["labels"] == "gpl,gpl-3.0,reserved" and rows[n + 3]["labels"] == "apache-2.0" and rows[n + 4]["labels"] == "cc-by,cc-by-nc-sa-4.0"
    assert license_rules.scan_licences(none, keep=["doc_id"]).count() == 0


def test_license_rules_are_many_and_suppressed():
    given = license_rules.rules()
    assert len(given) > 300 and all(r.keyword for r in given)
    assert sum(r.priority in (1, 2, 8) for r in given) > 200
    found = license_rules.Scanner().detections(" licensed under the apache license version 2 0 ")
    assert [r.label for *_, r in found] == ["apache-2.0"]
    assert [r.label for *_, r in license_rules.Scanner().detections(" see version 2 of the gnu general public license ")] == ["gpl-2.0", "gpl"]


def naive_detections(normal, given):
    """Every rule tried on the whole text, and containment looked up one by one."""
    hits = [(m.start() + 1, m.end(), r) for r in given for m in r.pattern.finditer(normal)]
    taken = []
    for start, end, rule in sorted((h for h in hits if not h[2].base), key=lambda h: (h[2].priority, h[0] - h[1], h[0], h[2].label)):
        if not any(a <= start and end <= b for a, b, _ in taken):
            taken.append((start, end, rule))
    return {(a, b, r.label) for a, b, r in taken + [h for h in hits if h[2].base]}


def test_license_scan_against_all_rules():
    rng, scanner = np.random.default_rng(5), license_rules.Scanner()
    words = sorted({w for r in scanner.rules for w in r.pattern.pattern.replace("(?:", " ").replace(")", " ").replace("|", " ").replace("?", " ").split() if w.isalnum()})
    plain = [r.pattern.pattern[4:-6] for r in scanner.rules]
    plain = [p for p in plain if all(c.isalnum() or c == " " for c in p)]
    assert len(plain) > 80
    for _ in range(60):
        parts = [str(rng.choice(plain)) if rng.random() < 0.3 else str(rng.choice(words)) for _ in range(40)]
        normal = f" {' '.join(parts)} "
        assert {(a, b, r.label) for a, b, r in scanner.detections(normal)} == naive_detections(normal, scanner.rules)


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6)), max_size=25))
def test_containment(given):
    taken, plain = [], []
    for start, size in given:
        held = any(a <= start and start + size <= b for a, b in plain)
        assert license_rules.contained(taken, start, start + size) == held
        if not held:
            plain.append((start, start + size))


def test_license_long_text_with_ties(spark):
    text = "Copyright 2020 Foo, MIT License. " * 20_000
    row = license_rules.scan_licences(spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, n_words string, detections string")).first()
    assert row["_n_words"] == 100_000 and row["n_words"] == "x" and len(row["_detections"]) == 40_000
    assert row["_detections"][1].asDict() == {"first_word": 3, "end_word": 5, "label": "mit", "base": False, "confidence": 0.6}
    tie = license_rules.Rule(1, "b", "one", license_rules._compiled("one two"), 0.5), license_rules.Rule(1, "a", "one", license_rules._compiled("one two"), 0.5)
    assert [r.label for *_, r in license_rules.Scanner(list(tie)).detections(" one two ")] == ["a"]


# 6: packing


def test_packing(spark, docs, corpus, none):
    rows = packing.pack(docs, TOKENIZER).collect()
    whole = Tokenizer.from_file(TOKENIZER)
    left = {}
    for doc_id, text, *_ in corpus:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        left.setdefault(doc_id, []).append(ids)
    for doc_id, lists in left.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == doc_id)
        expected = []
        for ids in lists:
            start = 0
            for n in packing.cut(len(ids)):
                expected.append((start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
                start += n
        assert pieces == sorted(expected)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1
    assert packing.pack(none, TOKENIZER).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.sampled_from([1, 3, 7, 31, 32, 64, 700, 2048, 3000, 4064, 4096]), st.integers(1, 60), min_size=1))
def test_patterns_use_up_the_demand(demand):
    lengths = sorted(demand)
    used = dict.fromkeys(lengths, 0)
    for times, counts in packing.patterns(lengths, [demand[x] for x in lengths]):
        assert sum(k * n for k, n in counts.items()) <= 4096
        for k, n in counts.items():
            used[k] += times * n
    assert used == demand


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.floats(0, 1)), min_size=1, max_size=6, unique_by=lambda x: x[0]))
def test_knapsack(items):
    best = [0.0] * 101
    for c in range(1, 101):
        best[c] = max([best[c - 1], *(best[c - w] + v for w, v in items if w <= c)])
    lengths, values = np.array([w for w, _ in items]), np.array([v for _, v in items])
    value, counts = packing.price(values, lengths, 100)
    assert math.isclose(value, best[100], abs_tol=1e-9) and counts @ lengths <= 100 and counts @ values >= value - 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\x01|>.,!'…İ日 \n̸", max_size=14), min_size=1, max_size=20))
def test_word_ids_equal_the_tokenizer(texts):
    memory, whole = packing.word_ids(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    chunk = next(bytewords.chunks(pa.array(texts)))
    ids, bounds = memory.encode(chunk)
    ids = np.frombuffer(ids, "<u4")
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


# 7: decontamination


def items_of(corpus):
    return [(1, " ".join(corpus[5][1].split()[10:40])), (2, "short item"), (3, None), (4, "..."), (None, " ".join(corpus[7][1].split()[:10]).upper()), (1, " ".join(corpus[6][1].split()[3:20]))]


@pytest.mark.parametrize(("block", "pairs"), [(decontam.BLOCK_WINDOWS, decontam.BLOCK_PAIRS), (7, 500), (40, 500), (500, 9)])
def test_decontamination(spark, docs, corpus, none, block, pairs):
    items = items_of(corpus)
    table = spark.createDataFrame(items, "item_id long, text string")
    extra = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(99)).withColumn("text", F.lit("a SHORT, item; short item")))
    found = decontam.digest(decontam.find_contamination(extra.select("doc_id", "text"), table, keep=["doc_id"], block_windows=block, block_pairs=pairs)).collect()
    expected = [(d, *brute.contamination(t, items)) for d, t in [(r[0], r[1]) for r in corpus] + [(99, "a SHORT, item; short item")]]
    assert multiset(map(tuple, found)) == multiset(expected)
    kept = decontam.remove_contaminated(docs, table)
    assert kept.columns == docs.columns and multiset((r["doc_id"], r["text"]) for r in kept.collect()) == multiset((r[0], r[1]) for r in corpus if not brute.contamination(r[1], items)[-1])
    assert decontam.find_contamination(none, table.limit(0), prefix="p_").count() == 0


def test_hits_map_to_the_original(spark):
    docs = spark.createDataFrame([(1, "É! one,two THREE four; end")], "doc_id long, text string")
    row = decontam.find_contamination(docs, spark.createDataFrame([(1, "two three")], "item_id long, text string")).first()
    (span,) = row["hit_bytes"]
    assert row["text"].encode()[span["start"] : span["end"]].decode() == "two THREE"


# 8: n-gram Jaccard join


@pytest.mark.parametrize("small", [32, 0])
def test_jaccard_join(docs, corpus, none, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    found = jaccard_join.digest(jaccard_join.near_duplicates(docs)).collect()
    assert multiset(map(tuple, found)) == multiset(brute.near_duplicates([(r[0], r[1]) for r in corpus]))
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_with_salts(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "ROW_BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "QUERY_BLOCK", 2)
    found = jaccard_join.digest(jaccard_join.near_duplicates(docs)).collect()
    assert multiset(map(tuple, found)) == multiset(brute.near_duplicates([(r[0], r[1]) for r in corpus]))


def test_one_of_each(docs, corpus):
    kept = jaccard_join.one_of_each(docs)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = brute.near_duplicates([(r[0], r[1]) for r in corpus])
    assert kept.columns == docs.columns
    full = [g for g in groups if g[1]]
    assert len(rows) == len({g[2] for g in full}) + sum(1 for g in groups if not g[1])
    assert {r[0] for r in rows if r[1] and r[1].strip()} == {g[2] for g in full}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components(spark, links):
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in links)}


# 9: repeated passages


def test_repeated_passages(docs, corpus, none):
    found = bwt_dedup.digest(bwt_dedup.removal(docs.select("doc_id", "text"), keep=["doc_id"], passages=True)).collect()
    texts = [r[1] for r in corpus]
    expected = [(r[0], *b, *p) for r, b, p in zip(corpus, brute.repeats(texts), brute.passages(texts, bwt_dedup.PASSAGE_WINDOW, bwt_dedup.PASSAGE_WORDS))]
    assert multiset(map(tuple, found)) == multiset(expected)
    assert sum(r["n_passages"] > 0 and r["n_removed"] == 0 for r in found) and sum(r["n_removed"] > 0 for r in found)
    assert bwt_dedup.removal(none, passages=True).count() == 0 and bwt_dedup.removal(none).count() == 0
    kept = bwt_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns
    assert sorted(len((r["text"] or "").encode()) for r in kept.collect()) == sorted(len((t or "").encode()) - p[1] for t, p in zip(texts, brute.passages(texts, bwt_dedup.PASSAGE_WINDOW, bwt_dedup.PASSAGE_WORDS)))


def test_repeated_passages_in_parts_of_long_texts(docs, corpus, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "PART", 700)
    rows = docs.select("doc_id", "text").collect()
    from strandgraph.llm.bytewords import chunks

    texts = [r["text"] for r in rows if r["text"] and len(r["text"]) > 3000]
    for chunk in chunks(pa.array(texts), target=1):
        starts = [int(b[0]) + np.arange(s.sum()) for _, _, b, s in bwt_dedup.parts(chunk)]
        assert np.concatenate(starts).tolist() == list(range(len(chunk.data) - bwt_dedup.WINDOW + 1))


def test_transform_merge(corpus):
    """The merge of shards' transforms finds the windows that the anchored refinement finds, and those of brute force."""
    texts = [(r[1] or "").encode() for r in corpus]
    shards = [texts[i : i + 20] for i in range(0, len(texts), 20)]
    found = [t for shard in bwt_merge.repeated(shards, 400) for t in shard]
    for data, starts, (n_bytes, n_removed, n_spans, _) in zip(texts, found, brute.repeats([r[1] for r in corpus])):
        gone = np.zeros(len(data) + 1, bool)
        for i in starts:
            gone[i : i + 400] = True
        assert (len(data), gone.sum(), (gone[1:] < gone[:-1]).sum()) == (n_bytes, n_removed, n_spans)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=24).map(lambda b: bytes(97 + x % 2 for x in b)), max_size=3), min_size=1, max_size=3), st.integers(1, 9))
def test_transform_merge_is_the_sorted_order(shards, depth):
    made = [bwt_merge.Shard(s, depth) for s in shards]
    interleave, common = bwt_merge.merge(made, depth)
    at, suffixes = [0] * len(made), []
    for i in interleave:
        shard, k = made[i], made[i].order[at[i]]
        at[i] += 1
        suffixes.append(shards[i][shard.text[k]][shard.place[k] :])
    cut = [s[:depth] for s in suffixes]
    assert cut == sorted(cut)
    for a, b, n in zip(cut, cut[1:], common[1:]):
        assert n == next((i for i in range(depth) if a[i : i + 1] != b[i : i + 1] or i >= len(a)), depth)


def test_clashing_names_by_default(spark):
    """Every operator that adds columns leaves those that a table has, whatever their names."""
    text = "Licensed under the MIT license, a text of some length. " * 12
    names = ["n_words", "detections", "hit_words", "hit_bytes", "hit_items", "score", "n_bytes", "n_removed", "n_spans", "kept", "n_chars", "_row", "_spans", "label", "row", "counted"]
    docs = spark.createDataFrame([(1, text, "en", "s", *names), (2, text, None, None, *names)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(7, "licensed under the mit license")], "item_id long, text string")
    found = {
        "scan": license_rules.scan_licences(docs),
        "items": decontam.find_contamination(docs, items),
        "items in blocks": decontam.find_contamination(docs, items.unionByName(items.withColumn("text", F.lit("not there"))), block_windows=1),
        "score": zstd_quality.score(docs, zstd_quality.Model(b"", b"", 0.0, 0.0)),
        "page": html_crf.main_text(docs.withColumn("html", F.col("text"))),
        "kept": quality_mcd.keep_good(docs),
        "one": jaccard_join.one_of_each(docs),
        "clean": decontam.remove_contaminated(docs, items),
        "short": bwt_dedup.remove_repeats(docs),
    }
    for name, df in found.items():
        assert len({c.lower() for c in df.columns}) == len(df.columns), name
        for r in df.collect():
            assert all(r[n] == n or (n == "n_chars" and name == "short") for n in names), name
    assert found["one"].count() == 1 and found["clean"].count() == 0
    removed = bwt_dedup.removal(docs).first()
    assert removed["_n_removed"] == len(text) and removed["n_removed"] == "n_removed"


# 10: WARC


def test_warc(spark):
    rng = np.random.default_rng(5)
    big = "".join(map(chr, rng.integers(0x20, 0x2FF, 700_000)))
    rows = [(5, "http://a\r\nX: y", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (7, None, None), (8, "http://c", ""), (9, "http://d", big), (None, "http://e", "<p>one</p>"), (3, "http://b", "<p>one</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha1 string")
    bundles = warc_bundles.write_bundles(pages, frame_bytes=2000, bundle_bytes=4000)
    found = warc_bundles.digest(warc_bundles.read_bundles(bundles)).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>one</p>": 3, "": 7, big: 9}
    expected = []
    for page_id, _, h in rows:
        revisit = page_id != first[h or ""]
        expected.append((page_id, len((h or "").encode()), digest(h), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert multiset(map(tuple, found)) == multiset(expected)
    held = [warc_bundles.BundleReader(r["content"]) for r in bundles.collect()]
    (record,) = [x for b in held for x in b.find(9)]
    assert warc_bundles.decode_record(record)["payload"].decode() == big
    loose = warc_bundles.digest(warc_bundles.read_bundles(warc_bundles.write_bundles(pages, min_bytes=5))).where("payload_bytes = 0")
    assert [r["record_type"] for r in loose.collect()] == ["response", "response"]
    assert warc_bundles.read_bundles(warc_bundles.write_bundles(pages.limit(0))).count() == 0


@pytest.mark.parametrize("few, hot", [(2, 10_000), (1, 3)])
def test_warc_with_many_digests(spark, monkeypatch, few, hot):
    monkeypatch.setattr(warc_bundles, "FEW_DIGESTS", few)
    monkeypatch.setattr(warc_bundles, "HOT", hot)
    rows = [(i, f"http://{i}", f"<p>{i % 5}</p>" if i % 3 else "<p>hot</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    found = warc_bundles.read_bundles(warc_bundles.write_bundles(pages)).select("page_id", "refers_to").collect()
    assert multiset(map(tuple, found)) == multiset((i, first[h] if first[h] != i else None) for i, _, h in rows)


def test_bundle_is_plain_zstandard():
    import zstandard

    writer = warc_bundles.BundleWriter(frame_bytes=50)
    records = [warc_bundles.encode_record(i, None, b"x" * i, "D", None, False) for i in range(5)]
    for i, r in enumerate(records):
        writer.add(i, r)
    reader = zstandard.ZstdDecompressor().stream_reader(writer.finish(), read_across_frames=True)
    assert reader.read() == b"".join(records)
