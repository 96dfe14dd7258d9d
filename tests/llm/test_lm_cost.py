"""What op12 spares: decisions by trees that know more, contexts met once for teaching and counting, words looked up where their hash says."""

import numpy as np
import pyarrow as pa

from strandgraph.llm import bytewords as B
from strandgraph.llm import lm_mixing as L
from strandgraph.llm import mixing as M


def stream(text):
    part = next(iter(B.chunks(pa.array([text]), L.CHUNK)))
    return next(iter(M.pieces(part, B.words(part, B.SPACES))))


def size_of(tree, data, bounds):
    at = M.coded(bounds)
    return int(tree.depth[tree.after(data, at) | data[at]].sum())


def test_trees_know_two_bytes(spark):
    """Where the byte after an a depends on the one before it, the model's trees take fewer decisions than those by one byte."""
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["bax", "cay", "daz", "eaw"], 5_000))
    data, bounds = stream(text)
    pairs = M.tree_of(np.bincount(M.pairs_of(data), minlength=1 << 16))
    _, counts = L.word_model(spark.createDataFrame([(text,)], "text string"))
    assert size_of(M.tree_of(counts), data, bounds) < 0.9 * size_of(pairs, data, bounds)


def test_events_are_all_decisions():
    """Events are told apart, hold every decision, and every byte finds its own."""
    rng = np.random.default_rng(4)
    data, bounds = stream(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"], 3_000)))
    tree, at = M.tree_of(np.bincount(M.triples_of(data), minlength=M.CLASSES << 16)), M.coded(bounds)
    found = M.decisions(data, bounds, at, np.arange(len(at)), tree)
    for cells, event in zip(found.cells, M.met(data, bounds, tree)):
        flat = event.first[found.byte] + np.arange(found.size) - found.begin[found.byte]
        assert (event.cells[flat] == cells).all() and (event.answers[flat] == found.answers).all()
        assert event.often.sum() == found.size and len(event.cells) < found.size / 20


def test_words_are_found_in_the_head():
    rng = np.random.default_rng(5)
    near = np.uint64(77) << np.uint64(64 - L.SLOT_BITS)
    for head in (np.unique(np.concatenate((rng.integers(0, 1 << 64, 50_000, np.uint64), near + np.arange(9, dtype=np.uint64) * np.uint64(2)))), np.array([near]), np.zeros(0, np.uint64)):
        hashes = np.concatenate((head, near + np.arange(20, dtype=np.uint64), rng.integers(0, 1 << 64, 1_000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
        place, common = L.found_in(head, L.slots_of(head), hashes)
        assert (common == np.isin(hashes, head)).all()
        assert (head[place[common]] == hashes[common]).all()
