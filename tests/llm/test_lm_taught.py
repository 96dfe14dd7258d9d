"""Every training text teaches the mixing weights."""

import numpy as np
import pyarrow as pa

from strandgraph.llm import bytewords as B
from strandgraph.llm import lm_mixing as L
from strandgraph.llm import mixing as M


def test_all_chunks_teach(spark):
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 70_000))
    assert len(text) > L.CHUNK
    part = next(iter(B.chunks(pa.array([text]), L.CHUNK)))
    data, bounds = next(iter(M.pieces(part, B.words(part, B.SPACES))))
    tree = M.tree_of(np.bincount(M.pairs_of(data), minlength=1 << 16))
    one = M.Counts().teach(M.Mixer.new(), data, bounds, tree)
    found = L.predictors(spark.createDataFrame([(text,)] * 3, "text string").coalesce(1), tree)
    assert [r["values"][0] for r in found.where("table < 0").collect()] == [3 * one]


def test_cells_as_bytes_keep_up_with_counts():
    """Teaching reads each table's cells as bytes, renewed where chunks are counted: what the counts themselves give, also when these are large."""
    rng = np.random.default_rng(6)
    counts = M.Counts()
    for _ in range(3):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 3_000))
        part = next(iter(B.chunks(pa.array([text]), L.CHUNK)))
        data, bounds = next(iter(M.pieces(part, B.words(part, B.SPACES))))
        tree = M.tree_of(np.bincount(M.pairs_of(data), minlength=1 << 16))
        counts.add(data, bounds, tree)
    assert counts.cells.max() > 300
    for cells, codes in zip(counts.cells, counts.codes):
        assert (codes == M.packed(cells[0::2].astype(float), cells[1::2].astype(float))).all()


def test_teaching_costs_no_logarithm_a_decision(monkeypatch):
    """A chunk's decisions read bytes; only cells whose counts changed are packed, and those of small counts by a table."""
    packed, plain = [], M.packed
    monkeypatch.setattr(M, "packed", lambda no, yes: (packed.append(len(no)), plain(no, yes))[1])
    part = next(iter(B.chunks(pa.array(["some words of a text " * 2_000]), L.CHUNK)))
    data, bounds = next(iter(M.pieces(part, B.words(part, B.SPACES))))
    tree = M.tree_of(np.bincount(M.pairs_of(data), minlength=1 << 16))
    counts = M.Counts()
    decisions = counts.teach(M.Mixer.new(), data, bounds, tree)
    counts.add(data, bounds, tree)
    assert 0 < sum(packed) < decisions / 100 and decisions > 40_000
