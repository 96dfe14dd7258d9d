"""Merge of the Burrows-Wheeler transforms of shards, by iterative refinement of their interleave.

A shard is a few texts; its transform is the symbol before each suffix, in the suffixes' order. Shards are merged without
sorting suffixes again: the interleave, which says from which shard each merged place comes, starts as one shard after
another, sorted by no symbol, and each round sorts it stably by the transforms' symbols, which makes it right for one more
symbol. Where a round first tells two neighbours apart, their common prefix is known. After `depth` rounds the places
that were never told apart are the intervals of strings of that length which repeat.

This is the plain method, for texts that fit one task. A round moves every suffix, so that its time is that of the bytes times
the depth: see the README for figures, and bwt_dedup for what the query runs instead. Tests hold the two against each other.
"""

from __future__ import annotations

import numpy as np

#: The symbol that ends each text. No two of them are equal, whatever follows.
END = 0


class Shard:
    """Texts with their suffixes sorted by `depth` symbols, and the transform: the symbol before each of them."""

    def __init__(self, texts: list[bytes], depth: int):
        data = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, END).astype(np.uint16) for t in texts]) if texts else np.zeros(0, np.uint16)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ends = np.flatnonzero(data == END)
        # Prefix doubling: the rank of a suffix by twice as many symbols is that of its two halves; a text's end is a rank of its own.
        rank = data.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        width = 1
        while width < depth:
            after = np.zeros(len(data), np.int64)
            after[: max(len(data) - width, 0)] = rank[width:] + 1
            after[self.place + width >= sizes[self.text]] = 0
            _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        before = np.empty(len(data), np.uint16)
        if len(data):
            before[1:], before[0] = data[:-1], END
        before[self.place == 0] = END
        self.transform = before[self.order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, common): the shard of each merged place, and how many symbols, depth at most, each suffix shares with
    the one before it."""
    interleave = np.repeat(np.arange(len(shards)), [len(s.order) for s in shards])
    n = len(interleave)
    common = np.full(n, depth, np.int64)
    kind = np.zeros(n, np.int64)  # suffixes not told apart yet
    told = np.zeros(n, bool)
    for known in range(depth):
        symbols = np.empty(n, np.uint16)
        for i, shard in enumerate(shards):
            symbols[interleave == i] = shard.transform
        order = np.argsort(symbols, kind="stable")
        moved, before = symbols[order], kind[order]
        now = np.ones(n, bool)
        now[1:] = (moved[1:] != moved[:-1]) | (moved[1:] == END) | (before[1:] != before[:-1])
        interleave = interleave[order]
        common[now & ~told] = known
        told, kind = now, np.cumsum(now)
        if told.all():
            break
    return interleave, common


def repeated(shards: list[list[bytes]], depth: int) -> list[list[np.ndarray]]:
    """For each text of each shard, the places where a string of depth bytes starts that also starts anywhere else."""
    made = [Shard(texts, depth) for texts in shards]
    interleave, common = merge(made, depth)
    shared = common >= depth
    if len(shared):
        shared[:-1] |= shared[1:]
    out = []
    for i, shard in enumerate(made):
        places = shard.order[shared[interleave == i]]
        out.append([np.sort(shard.place[places[shard.text[places] == t]]) for t in range(len(shards[i]))])
    return out
