"""op12: the word model against plain counting, and what makes the mixed model a probability."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandgraph.llm import bytewords as B
from strandgraph.llm import lm_mixing, mixing

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain(rows):
    train = [t for i, t in rows if i is not None and not held_out(i)]
    counts = Counter(w for t in train for w in tokens(t))
    total, kinds = sum(counts.values()) + len(train), len(counts) + bool(train)
    log = lambda c: math.log10((c + 1) / (total + kinds + 1))
    out = []
    for i, t in rows:
        words = tokens(t)
        out.append((str(i), held_out(i), len(words) + 1, sum(w in counts for w in words) + bool(train), total, round(sum(log(counts[w]) for w in words) + log(len(train)), 6)))
    return sorted(out)


def told(docs, head):
    model = lm_mixing.fit(docs, head=head)
    rows = lm_mixing.digest(lm_mixing.score(docs, model, keep=["doc_id"]), model).collect()
    return rows, sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


@pytest.mark.parametrize("head", [1 << 18, 20, 0])
def test_base_equals_plain_counting(docs, corpus, head):
    """Null, empty, blank, long and repeated texts; words looked up in the broadcast head, in the join, or both."""
    rows, found = told(docs, head)
    assert found == plain([(r[0], r[1]) for r in corpus])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    repeated = [r["score"] for r in rows if r["doc_id"] == corpus[3][0]]
    assert len(repeated) == 3 and max(repeated) - min(repeated) < 1e-9


def test_empty_tables_and_no_training(spark, docs, none):
    model = lm_mixing.fit(none)
    assert lm_mixing.score(none, model).collect() == []
    some = lm_mixing.digest(lm_mixing.score(docs, model, keep=["doc_id"]), model).collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in some)
    only_null = spark.createDataFrame([(None, None)], "doc_id long, text string")
    model = lm_mixing.fit(only_null)
    assert [(r["held_out"], r["n_tokens"], r["n_known"]) for r in lm_mixing.digest(lm_mixing.score(only_null, model, keep=["doc_id"]), model).collect()] == [(False, 1, 0)]


def test_extra_columns_stay_and_names_give_way(docs, corpus):
    model = lm_mixing.fit(docs)
    found = lm_mixing.score(docs, model)
    assert found.columns == [*docs.columns, "n_tokens", "n_known", "base_score", "_score", "n_bytes", "bits_per_byte"]
    assert found.count() == len(corpus) and found.where("score = 'y'").count() == len(corpus)
    assert found.where("n_bytes > 40 AND abs(_score + bits_per_byte * n_bytes * log10(2)) > 1e-6 * n_bytes").count() == 0


def stream(texts):
    (part,) = B.chunks(pa.array(texts), 1 << 30)
    return mixing.streams(part, B.words(part, B.SPACES))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(120)]
    data, bounds = stream(texts)
    tree = mixing.tree_of(np.bincount(mixing.pairs_of(data), minlength=1 << 16))
    counts, mixer = mixing.Counts(), mixing.Mixer.new()
    counts.add(data, bounds, tree)
    more = stream([" ".join(rng.choices(words, k=150)) for _ in range(60)])
    counts.teach(mixer, *more, tree)
    cells = np.stack([mixing.packed(c[0::2].astype(float), c[1::2].astype(float)) for c in counts.cells])
    return mixing.Model(tree, cells, mixer), words


def test_streams_hold_the_words():
    data, bounds = stream(["A  bÉ\tc", None, " \n", "x"])
    parts = [bytes(data[a + mixing.PAD : b]) for a, b in zip(bounds, bounds[1:])]
    assert parts == ["a bÉ c \n".encode(), b"\n", b"\n", b"x \n"]


@pytest.mark.parametrize("repeats", [0, 1, 30])
def test_next_bytes_have_probability_one(model, repeats):
    """After any prefix, the probabilities of the 256 next bytes add up to one: also with matches, and with a corrected last stage."""
    bits, words = model
    prefix = (" ".join(words[:12] * repeats)[:1500] or "a").encode()
    rows = [prefix, *(prefix + bytes([b]) for b in range(256))]
    data = np.frombuffer(b"".join(bytes(mixing.PAD) + r for r in rows), np.uint8).copy()
    bounds = np.concatenate(([0], np.cumsum([len(r) + mixing.PAD for r in rows])))
    cost, _ = bits.bits(data, bounds)
    assert abs(np.exp2(cost[0] - cost[1:]).sum() - 1) < 1e-6


def test_rows_do_not_see_each_other(model):
    bits, words = model
    rng = random.Random(2)
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 3, 700, 40, 40)] + ["", None, "zz " * 500]
    together, _ = bits.bits(*stream(texts))
    apart = [bits.bits(*stream([t]))[0][0] for t in texts]
    assert np.allclose(together, apart)


def test_the_model_learns_and_matches(model):
    bits, words = model
    rng = random.Random(3)
    text = " ".join(rng.choices(words, k=400))
    noise = "".join(rng.choices("hijklmnop ", k=len(text)))
    known, unknown, twice = (bits.bits(*stream([t]))[0][0] for t in (text, noise, f"{text} {text}"))
    assert known < 0.6 * unknown
    assert twice < 1.98 * known  # the training texts repeat nothing, so only the last stage learns to trust a match


def test_matches_find_the_last_like_place():
    data, bounds = stream(["abcdefgh abcdefgi", "abcdefgh"])
    at = mixing.coded(bounds)
    expected, held = mixing.matches(data, bounds, at)
    found = {int(i): (chr(e), int(h)) for i, (e, h) in enumerate(zip(expected, held)) if h}
    assert found == {15: ("g", 1), 16: ("h", 1)}


def test_long_texts_go_piece_by_piece(model, monkeypatch):
    bits, words = model
    rng = random.Random(5)
    text = " ".join(rng.choices(words, k=3000))
    whole, _ = bits.bits(*stream([text]))
    monkeypatch.setattr(mixing, "PIECE", 2000)
    (part,) = B.chunks(pa.array([text]))
    cost, state, held = 0.0, None, b""
    for data, bounds in mixing.pieces(part, B.words(part, B.SPACES)):
        more, state = bits.bits(data, bounds, state)
        cost, held = cost + more[0], held + bytes(data[mixing.PAD :])
    assert held == (text + " \n").encode()
    assert abs(cost - whole[0]) < 0.02 * whole[0]


def test_counts_are_those_of_single_decisions(model):
    """Counting equal events at once gives what counting them one by one gives."""
    bits, words = model
    data, bounds = stream([" ".join(words[:50]), " ".join(words[20:90])])
    counts = mixing.Counts()
    counts.add(data, bounds, bits.tree)
    at = mixing.coded(bounds)
    found = mixing.decisions(data, bounds, at, np.arange(len(at)), bits.tree)
    for i in range(mixing.TABLES):
        one = np.bincount(2 * found.cells[i] + found.answers, minlength=2 * mixing.CELLS)
        assert (one == counts.cells[i]).all()


def test_counts_add_up_in_levels(spark, docs, monkeypatch):
    """Tables summed two tasks at a time are those summed at once."""
    texts = docs.repartition(7).select("text").cache()
    _, pairs = lm_mixing.word_model(texts)
    found = lm_mixing.predictors(texts, mixing.tree_of(pairs)).cache()
    told = lambda: sorted((r["table"], r["segment"], bytes(r["cells"])) for r in lm_mixing.summed(found).collect())
    whole = told()
    monkeypatch.setattr(lm_mixing, "FAN", 2)
    assert told() == whole and len(whole) == mixing.TABLES * lm_mixing.SEGMENTS


def test_held_out_texts_cost_less_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm_mixing.fit(docs)
    rows = lm_mixing.digest(lm_mixing.score(docs, model, keep=["doc_id"]), model).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert np.corrcoef([r["score"] for r in rows], [r["base_score"] for r in rows])[0, 1] > 0.95
