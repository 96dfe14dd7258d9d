"""Logistic mixing of hashed-context bit predictors, on NumPy arrays of many texts at once.

A text is the stream of its lower-cased words, each followed by a space, and an end byte. A byte is coded by the yes-no decisions
of the Huffman tree of the byte before it and the class of the one before that, so that likely bytes take few. Each decision is predicted by

* one table a context (the last 3 bytes, the last 5, the word so far): its cell, found by a hash of the context and the tree's node, tells how
  often the decision was yes and no in the training texts; a context's cells are neighbours, in one line of memory;
* a match: the last place in the same text after the same six bytes, whose next byte says what to expect.

Predictions become logits, and are added up with weights that a gate chooses: how long the match has held, and how often the
longest context and the word so far were seen. A last stage corrects the sum by what became of like sums: as in training at first, then more and more
as in the text at hand, block by block. Every prediction rests on bytes before it alone, so a text's probabilities multiply.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from . import bytewords as B

#: Bytes of the last contexts, and the predictors in all: the word so far comes last.
ORDERS = (3, 5)
TABLES = len(ORDERS) + 1
#: Cells of a table.
BITS = 22
CELLS = 1 << BITS
#: A cell as one byte: how sure its count is (2 bits) and its logit (6 bits, steps of a quarter from -8).
LEVELS, STEP, SURE = 64, 0.25, (1, 3, 16)
GATES = 64
MATCH_BYTES, MATCH_SURE = 6, (1, 16, 32)
#: What a match is worth as a logit before it is weighed.
MATCH_LOGIT = 2.0
#: Buckets of the last stage, for each length of the match; its weight in training's favour; bytes between its updates, at a text's
#: begin and later; and its share in the answer.
BUCKETS, PRIOR, BLOCK, LATER, LAST = 32, 64.0, 128, 1024, 0.5
SPACE, END, PAD = 0x20, 0x0A, 8
#: Bytes of a long text that are predicted at once; a match looks back no further.
PIECE = 1 << 20
#: Bytes whose decisions are made at once, so that what is made of them stays in a core's cache.
SLICE = 1 << 15
#: Bytes in classes: a letter each, the space (and what stands before a text), digits, UTF-8's later and first bytes, stops, others.
CLASSES = 32
CLASS = np.full(256, 31)
CLASS[0x61:0x7B] = np.arange(26)
CLASS[[0, SPACE]], CLASS[0x30:0x3A], CLASS[0x80:0xC0], CLASS[0xC0:], CLASS[[0x2C, 0x2E, 0x3A, 0x3B]] = 26, 27, 28, 29, 30
#: A class and a byte have a tree of their own if at least one in OWN_TREE places comes after them; so there are fewer than 2 ** TREE_BITS trees.
OWN_TREE, TREE_BITS = 1 << 13, 14
INPUTS = TABLES + 2
LEAST = 2.0**-14


@dataclass(frozen=True)
class Tree:
    """A byte's decisions, by 256 * its tree + the byte: steps (the node, and the answer in bit 6) at start .. start + depth, and all answers
    as code, from the top bit down. The tree is by 256 * (class of the byte two before) + the byte before."""

    tree: np.ndarray
    depth: np.ndarray
    start: np.ndarray
    steps: np.ndarray
    code: np.ndarray

    def after(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """256 * the tree of the bytes at `at`."""
        return self.tree.take(CLASS.take(data[at - 2]) << 8 | data[at - 1])

    def walk(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The steps of bytes (256 * tree + byte), one after another; the byte that each belongs to, and where each byte's begin."""
        depth = self.depth.take(values)
        ends = np.cumsum(depth)
        begin = ends - depth
        byte = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        byte[begin[1:]] = 1
        np.cumsum(byte, out=byte)
        flat, start = np.ones(len(byte), np.int64), self.start.take(values)
        flat[begin[1:]] = start[1:] - (start + depth)[:-1] + 1
        flat[:1] = start[:1]
        return self.steps.take(np.cumsum(flat, out=flat), mode="clip"), byte, begin


def paths_of(counts: list[int]) -> list[list[tuple[int, int]]]:
    """Each byte's (node, answer) steps in the Huffman tree of counts; nodes are numbered from the root by weight, modulo 64. Each counts once more, and at least a 2 ** 24th of all, so that
    paths have under 40 steps."""
    floor = sum(counts) >> 24
    heap = [(max(c, floor) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    kids = {}
    while len(heap) > 1:
        one, two = heapq.heappop(heap), heapq.heappop(heap)
        name = 256 + len(kids)
        kids[name] = (one[2], two[2])
        heapq.heappush(heap, (one[0] + two[0], name, name))
    paths, open_ = [[]] * 256, [(heap[0][2], [])]
    while open_:
        name, path = open_.pop()
        if name < 256:
            paths[name] = path
        else:
            open_ += [(kid, [*path, ((510 - name) % 64, answer)]) for answer, kid in enumerate(kids[name])]
    return paths


def tree_of(counts: np.ndarray) -> Tree:
    """The trees of counts of bytes by 256 * before + byte, or by 65536 * class + that; bytes that come before none share one tree."""
    counts = counts.reshape(-1, 256, 256)
    pairs, after = counts.sum(axis=0), counts.sum(axis=2)
    rows, none = [row if any(row) else [0] * 256 for row in pairs.tolist()], paths_of([0] * 256)
    tree = np.tile(np.arange(256), (CLASSES, 1))
    for k, before in np.argwhere(after * OWN_TREE >= max(int(after.sum()), 1)).tolist() if len(counts) > 1 else []:
        tree[k, before] = len(rows)
        rows.append(counts[k, before].tolist())
    paths = [path for row in rows for path in (paths_of(row) if any(row) else none)]
    depth = np.array([len(p) for p in paths])
    flat = np.array([step for p in paths for step in p], np.int64)
    code = np.array([sum(a << (63 - i) for i, (_, a) in enumerate(p)) for p in paths], np.uint64)
    return Tree(tree.reshape(-1) << 8, depth, np.cumsum(depth) - depth, (flat[:, 0] | flat[:, 1] << 6).astype(np.uint8), code)


def pairs_of(data: np.ndarray) -> np.ndarray:
    """256 * before + byte for each place but the first."""
    return data[:-1].astype(np.int64) << 8 | data[1:]


def triples_of(data: np.ndarray) -> np.ndarray:
    """65536 * class two before + 256 * before + byte for each place but the first two."""
    return CLASS.take(data[:-2]) << 16 | data[1:-1].astype(np.int64) << 8 | data[2:]


def streams(texts: B.Texts, found: B.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each row's begin, one more at the end): PAD zeros, the words with a space after each, and the end byte."""
    sizes = found.ends - found.starts
    words = np.diff(found.rows)
    total = np.concatenate(([0], np.cumsum(sizes)))
    length = PAD + 1 + words + (total[found.rows[1:]] - total[found.rows[:-1]])
    bounds = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(int(bounds[-1]), np.uint8)
    row = np.repeat(np.arange(texts.n), words)
    begin = total[:-1] - total[found.rows[:-1]][row] + (np.arange(len(sizes)) - found.rows[:-1][row]) + bounds[row] + PAD
    at = np.arange(total[-1]) - np.repeat(total[:-1], sizes)
    data = texts.data[at + np.repeat(found.starts, sizes)]
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    out[at + np.repeat(begin, sizes)] = data
    out[begin + sizes] = SPACE
    out[bounds[1:] - 1] = END
    return out, bounds


def pieces(texts: B.Texts, found: B.Words):
    """The stream of a chunk's rows and words, or, of one long row, its parts in turn: each begins with the last bytes of the one before."""
    if texts.n > 1 or len(texts.data) <= PIECE:
        yield streams(texts, found)
        return
    edges = [*np.unique(np.searchsorted(found.starts, np.arange(0, len(texts.data), PIECE))).tolist(), len(found.starts)]
    before = np.zeros(PAD, np.uint8)
    for lo, hi in zip(edges, edges[1:]) if len(edges) > 1 else [(0, 0)]:
        data, bounds = streams(texts, B.Words(found.starts[lo:hi], found.ends[lo:hi], np.array([0, hi - lo])))
        if hi < edges[-1]:
            data, bounds = data[:-1], bounds - [0, 1]
        data[:PAD] = before
        before = data[-PAD:].copy()
        yield data, bounds


def coded(bounds: np.ndarray) -> np.ndarray:
    """The places of a stream's bytes but for padding."""
    sizes = np.diff(bounds) - PAD
    return np.arange(int(sizes.sum())) + PAD * (np.repeat(np.arange(len(sizes)), sizes) + 1)


def eight_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes before each place as a number, the nearest on top."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at - 8]


def contexts(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """For each predictor, 32-bit hashes of what comes before the bytes at `at`. Where no word has begun, the last one says the class of the byte two before, as
    the trees do."""
    eight = eight_before(data, at) if eight is None else eight
    out = np.empty((TABLES, len(at)), np.uint32)
    for i, order in enumerate(ORDERS):
        out[i] = spread((eight >> np.uint64(64 - 8 * order)) + (np.uint64(i + 1) << np.uint64(56)))
    letters = (data != SPACE) & (data != 0)
    first = np.flatnonzero(letters & ~np.concatenate(([False], letters[:-1])))
    begin = np.zeros(len(data), np.int64)
    begin[first] = first
    np.maximum.accumulate(begin, out=begin)
    place = np.arange(len(data))
    place -= begin
    np.minimum(place, 255, out=place)
    terms = LETTERS.take(data)
    terms *= B.powers_for(256).take(place)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    last = at - 1
    words = sums.take(at)
    words -= sums.take(begin.take(last))
    outside = np.flatnonzero(~letters.take(last))
    words[outside] = CLASS.take(data[at[outside] - 2]) + 1
    out[TABLES - 1] = spread(words)
    return out


#: A number for each byte of a word, 0 for what stands outside.
LETTERS = B.stream(256, 5)
LETTERS[[0, SPACE]] = 0


def spread(x: np.ndarray) -> np.ndarray:
    """32-bit hashes: the upper half of a product of which the upper bits were folded in before."""
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0x9FB21C651E98DF25)
    x >>= np.uint64(32)
    return x.astype(np.uint32)


def matches(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, eight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the byte that a match expects, how long the match has held: 0 none, up to 3) for the bytes at `at`."""
    n = len(at)
    bits = max(int(n).bit_length(), 1)
    keys = (eight_before(data, at) if eight is None else eight) >> np.uint64(64 - 8 * MATCH_BYTES)
    keys *= np.uint64(0x9E3779B97F4A7C15)
    keys += np.repeat(np.arange(1, len(bounds), dtype=np.uint64), np.diff(bounds) - PAD)
    keys = B.mix(keys) >> np.uint64(2 + bits)
    keys <<= np.uint64(bits)
    keys |= np.arange(n, dtype=np.uint64)
    keys = ordered(keys)
    place = (keys & np.uint64((1 << bits) - 1)).view(np.int64)
    keys >>= np.uint64(bits)
    same = np.flatnonzero(keys[1:] == keys[:-1])
    before = np.full(n, -1, np.int64)
    before[place[same + 1]] = place[same]
    there = before >= 0
    expected = data.take(at.take(np.maximum(before, 0)))
    goes_on = there[1:] & there[:-1]
    goes_on &= before[1:] == before[:-1] + 1
    run = np.arange(n)
    begin = run.copy()
    begin[1:][goes_on] = 0
    np.maximum.accumulate(begin, out=begin)
    run -= begin
    held = there.astype(np.uint8)
    for sure in MATCH_SURE[1:]:
        held += there & (run >= sure - 1)
    return expected, held


@dataclass
class Decisions:
    """All decisions of some bytes, in their order: the match's say, answers, and the byte that each belongs to; nodes, and tables' cells if asked for."""

    match: np.ndarray
    held: np.ndarray
    answers: np.ndarray
    byte: np.ndarray
    begin: np.ndarray
    nodes: np.ndarray
    cells: np.ndarray | None = None

    @cached_property
    def size(self) -> int:
        return len(self.answers)

    def placed(self, hashes: np.ndarray) -> Decisions:
        """With tables' cells, given the bytes' contexts."""
        self.cells, nodes = np.empty((TABLES, self.size), np.int64), self.nodes.astype(np.int64)
        hashes = (hashes & np.uint32(CELLS - 1)).astype(np.int64)
        for cells, context in zip(self.cells, hashes):
            context.take(self.byte, mode="clip", out=cells)
            cells ^= nodes
        return self


def decisions(data: np.ndarray, bounds: np.ndarray, at: np.ndarray, order: np.ndarray, tree: Tree) -> Decisions:
    """The decisions of the bytes at `at`, bytes taken in the given order."""
    hashes, (expected, held) = contexts(data, bounds, at), matches(data, bounds, at)
    before = tree.after(data, at)
    return decided(before[order], (before | data[at])[order], expected[order], held[order], tree).placed(hashes[:, order])


def decided(before: np.ndarray, values: np.ndarray, expected: np.ndarray, held: np.ndarray, tree: Tree) -> Decisions:
    """The decisions of bytes, given as 256 * their tree alone and with the byte, whose matches are given."""
    steps, byte, begin = tree.walk(values)
    nodes, answers = steps & np.uint8(63), steps >> np.uint8(6)
    # what the match says of a decision: no and yes as -1 and 1 until the last one that it has a say in, of which it is wrong unless it is right in all
    until = np.full(len(values), -4)
    some = np.flatnonzero(held)
    differ = tree.code.take(values[some]) ^ tree.code.take(before[some] | expected[some])
    last = begin[some] + np.where(differ == 0, 64, 64 - np.frexp(np.maximum(differ, 1).astype(np.float64))[1])
    until[some] = last << 2 | held[some]
    until = until.take(byte, mode="clip")
    held = until.astype(np.uint8)
    held &= np.uint8(3)
    until >>= 2
    place = np.arange(len(byte))
    says = (place <= until).view(np.int8)
    match = ((answers ^ (place == until).view(np.uint8)) << np.uint8(1)).view(np.int8)
    match -= np.int8(1)
    match *= says
    held *= says.view(np.uint8)
    return Decisions(match, held, answers, byte, begin, nodes)


@dataclass
class Events:
    """A table's distinct events in a stream (a byte after a context) in the order of their cells: all their decisions' cells and answers, how
    often each occurred, and where each byte's event has its first."""

    cells: np.ndarray
    answers: np.ndarray
    often: np.ndarray
    first: np.ndarray


def events(hashes: np.ndarray, values: np.ndarray, tree: Tree) -> Events:
    """The events of bytes (256 * tree + byte) after contexts."""
    bits = max(len(values).bit_length(), 1)
    keys = (hashes & np.uint32(CELLS - 1)).astype(np.uint64)
    keys <<= np.uint64(TREE_BITS + 8)
    keys |= values.view(np.uint64)
    keys <<= np.uint64(bits)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys = ordered(keys)
    place = (keys & np.uint64((1 << bits) - 1)).view(np.int64)
    keys >>= np.uint64(bits)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    steps, byte, begin = tree.walk(values.take(place.take(starts)))
    cells = (keys.take(starts) >> np.uint64(TREE_BITS + 8)).view(np.int64).take(byte, mode="clip")
    cells ^= steps & np.uint8(63)
    event = np.cumsum(new)
    event -= 1
    first = np.empty(len(values), np.int64)
    first[place] = begin.take(event)
    return Events(cells, steps >> np.uint8(6), np.diff(starts, append=len(keys)).astype(np.uint32).take(byte, mode="clip"), first)


def ordered(keys: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 62 in order: as the bits of positive floating-point numbers, which are ordered alike and sorted faster."""
    return np.sort(keys.view(np.float64)).view(np.uint64)


class Counts:
    """Yes and no counts of each table's cells, and the cells as bytes."""

    def __init__(self):
        self.cells = np.zeros((TABLES, 2 * CELLS), np.uint32)
        self.codes = np.full((TABLES, CELLS), PACKED[0], np.uint8)

    def add(self, data: np.ndarray, bounds: np.ndarray, tree: Tree, found: list[Events] | None = None) -> None:
        """Count a stream's decisions, from the events found if they are known: cells are touched once for most equal ones, and in their order."""
        for cells, codes, event in zip(self.cells, self.codes, met(data, bounds, tree) if found is None else found):
            np.add.at(cells, event.cells << 1 | event.answers, event.often)
            codes[event.cells] = coded_cells(cells.view("<u8").take(event.cells, mode="clip"))

    def teach(self, mixer: Mixer, data: np.ndarray, bounds: np.ndarray, tree: Tree, found: list[Events] | None = None) -> int:
        """Let the mixer learn from a stream, predicted by the counts so far, from the events found if they are known; SLICE bytes at a
        time. Returns the number of decisions."""
        at, size = coded(bounds), 0
        before = tree.after(data, at)
        values = before | data[at]
        found = met(data, bounds, tree) if found is None else found
        codes = [codes.take(event.cells, mode="clip") for codes, event in zip(self.codes, found)]
        expected, held = matches(data, bounds, at)
        for lo in range(0, len(at), SLICE):
            s = slice(lo, lo + SLICE)
            some = decided(before[s], values[s], expected[s], held[s], tree)
            place = np.arange(some.size)
            here = np.empty((TABLES, some.size), np.uint8)
            for out, code, event in zip(here, codes, found):
                flat = (event.first[s] - some.begin).take(some.byte, mode="clip")
                flat += place
                code.take(flat, mode="clip", out=out)
            mixer.learn(here, some)
            size += some.size
        return size


def met(data: np.ndarray, bounds: np.ndarray, tree: Tree) -> list[Events]:
    """The events of a stream, for each table."""
    at = coded(bounds)
    values = tree.after(data, at) | data[at]
    return [events(hashes, values, tree) for hashes in contexts(data, bounds, at)]


def packed(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Cells as bytes."""
    logit = np.log((yes + 0.4) / (no + 0.4))
    level = np.clip(np.rint(logit / STEP) + LEVELS // 2, 0, LEVELS - 1).astype(np.uint8)
    return level | (np.searchsorted(SURE, no + yes, "right") << 6).astype(np.uint8)


#: Cells as bytes by 256 * no + yes, for counts below 256.
PACKED = packed(*np.divmod(np.arange(1 << 16, dtype=np.float64), 256))


def coded_cells(counts: np.ndarray) -> np.ndarray:
    """Cells as bytes; counts: no in the lower half of 64 bits, yes in the upper."""
    out = PACKED.take((counts << np.uint64(8) | counts >> np.uint64(32)).astype(np.uint16))
    many = np.flatnonzero(counts & np.uint64(0xFFFFFF00FFFFFF00))
    out[many] = packed((counts[many] & np.uint64(0xFFFFFFFF)).astype(np.float64), (counts[many] >> np.uint64(32)).astype(np.float64))
    return out


#: A cell's byte as a logit; cells never counted have the middle level.
LOGITS = np.tile((np.arange(LEVELS, dtype=np.float32) - LEVELS // 2) * np.float32(STEP), 4)
#: What a match says, by the lower two bits of a place in a table of gates.
MATCH_SAYS = np.array([-1, 0, 1, 0], np.float32)


def levels(codes: np.ndarray) -> np.ndarray:
    """Cells' logits in steps."""
    out = (codes & np.uint8(LEVELS - 1)).astype(np.float32)
    out -= np.float32(LEVELS // 2)
    return out


def gate(held: np.ndarray, longest: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How long the match has held, and how sure the longest context and the word are."""
    return (held << 4) | (longest >> 6 << 2) | (word >> 6)


def squash(x: np.ndarray) -> np.ndarray:
    out = np.exp(-x)
    out += 1
    np.divide(1, out, out=out)
    np.maximum(out, LEAST, out=out)
    return np.minimum(out, 1 - LEAST, out=out)


def bucket(logit: np.ndarray, held: np.ndarray) -> np.ndarray:
    out = logit * 2
    np.rint(out, out=out)
    out += BUCKETS // 2
    np.maximum(out, 0, out=out)
    np.minimum(out, BUCKETS - 1, out=out)
    return out.astype(np.uint8) + np.uint8(BUCKETS) * held


@dataclass
class Mixer:
    """Weights by gate, and, for the last stage, training's counts of (all, yes) by bucket."""

    weights: np.ndarray
    seen: np.ndarray

    @classmethod
    def new(cls) -> Mixer:
        weights = np.full((GATES, INPUTS), 0.3)
        weights[:, -1] = 0.0
        return cls(weights, np.zeros((2, 4 * BUCKETS)))

    def learn(self, codes: np.ndarray, found: Decisions, rate: float = 0.02, batch: int = 4096) -> None:
        """Online steps down the gradient of the coding cost, over decisions predicted from codes (each table's cells as bytes)."""
        x = levels(codes)
        gates = gate(found.held, codes[TABLES - 2], codes[TABLES - 1]).astype(np.int64)
        says = gates << 2
        says += found.match
        says += 1
        no, logit = 1 - found.answers.astype(np.float32), np.empty(found.size, np.float32)
        step, scale = np.empty((INPUTS, GATES)), np.array([STEP] * TABLES + [MATCH_LOGIT, 0.3])[:, None]
        for lo in range(0, found.size, batch):
            s = slice(lo, lo + batch)
            here, said, values = gates[s], says[s], x[:, s]
            weights = (self.weights.T * scale).astype(np.float32)
            parts = weights[:TABLES].take(here, axis=1, mode="clip")
            parts *= values
            out = (weights[-2][:, None] * MATCH_SAYS + weights[-1][:, None]).reshape(-1).take(said, mode="clip", out=logit[s])
            for part in parts:
                out += part
            miss = np.exp(out)
            miss += 1
            np.divide(1, miss, out=miss)
            miss -= no[s]
            np.multiply(values, miss, out=parts)
            for i, part in enumerate(parts):
                step[i] = np.bincount(here, part, minlength=GATES)
            missed = np.bincount(said, miss, minlength=4 * GATES).reshape(GATES, 4)
            step[-2], step[-1] = missed[:, 2] - missed[:, 0], missed[:, 0] + missed[:, 1] + missed[:, 2]
            step *= rate * scale
            step /= np.sqrt(np.bincount(here, minlength=GATES) + 1.0)
            self.weights += step.T
        no, yes = np.bincount(bucket(logit, found.held) + (found.answers << np.uint8(7)), minlength=8 * BUCKETS).reshape(2, -1)
        self.seen += np.stack((no + yes, yes))


@dataclass
class Model:
    tree: Tree
    #: Each table's cells as bytes.
    cells: np.ndarray
    mixer: Mixer

    @cached_property
    def added(self) -> list[np.ndarray]:
        """For each table, what a cell's level adds to the logit, by gate."""
        return [(self.mixer.weights[:, i][:, None] * LOGITS[None, :LEVELS]).astype(np.float32).reshape(-1) for i in range(TABLES)]

    @cached_property
    def prior(self) -> np.ndarray:
        """(PRIOR, PRIOR times the share of yes) by bucket, as training found it."""
        middle = 1 / (1 + np.exp(-(np.arange(4 * BUCKETS) % BUCKETS - BUCKETS // 2) / 2))
        share = (self.mixer.seen[1] + 4 * middle) / (self.mixer.seen[0] + 4)
        return np.stack([np.full(4 * BUCKETS, PRIOR), PRIOR * share])

    @cached_property
    def begun(self) -> np.ndarray:
        """What the match and the constant add to the logit, by gate and by what the match says (no, nothing, yes)."""
        says = MATCH_SAYS * MATCH_LOGIT
        return (self.mixer.weights[:, -2][:, None] * says + 0.3 * self.mixer.weights[:, -1][:, None]).astype(np.float32).reshape(-1)

    def logits(self, found: Decisions) -> np.ndarray:
        codes = [self.cells[i].take(found.cells[i], mode="clip") for i in range(TABLES)]
        gates = gate(found.held, codes[TABLES - 2], codes[TABLES - 1]).astype(np.int64)
        out = self.begun.take((gates << 2) + (found.match + 1), mode="clip")
        gates <<= 6
        for i in range(TABLES):
            out += self.added[i].take(gates | (codes[i] & np.uint8(LEVELS - 1)), mode="clip")
        return out

    def bits(self, data: np.ndarray, bounds: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each row of a stream, and the last stage's state after it; given a state, rows go on from it."""
        n = len(bounds) - 1
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds) - PAD)
        at = coded(bounds)
        block = at - bounds[row] - PAD
        block = np.where(block < LATER, block // BLOCK, block // LATER + LATER // BLOCK - 1)
        order = np.argsort(block.astype(np.uint16) if len(block) == 0 or block.max() < 1 << 16 else block, kind="stable")
        eight = eight_before(data, at)
        hashes, (expected, held) = contexts(data, bounds, at, eight), matches(data, bounds, at, eight)
        before = self.tree.after(data, at)
        values = before | data[at]
        parts, depth = [], self.tree.depth.take(values.take(order))
        for lo in range(0, len(at), SLICE):
            some = order[lo : lo + SLICE]
            found = decided(before[some], values[some], expected[some], held[some], self.tree).placed(hashes[:, some])
            logit = self.logits(found)
            where = (row[some].astype(np.int64) * (4 * BUCKETS)).take(found.byte, mode="clip")
            where += bucket(logit, found.held)
            parts.append((squash(logit), where, found.answers))
        all_, yes = np.tile(self.prior[:, None, :], (1, n, 1)).reshape(2, -1) if state is None else state
        if not parts:
            return np.zeros(n), np.stack((all_, yes))
        first, where, answers = (np.concatenate(p) for p in zip(*parts))
        share, turned = np.empty(len(first)), np.concatenate(([0], np.cumsum(depth)))
        turns = turned[np.searchsorted(block[order], np.arange(int(block.max()) + 2))]
        for lo, hi in zip(turns[:-1].tolist(), turns[1:].tolist()):
            w, a = where[lo:hi], answers[lo:hi]
            if 2 * (hi - lo) > len(all_):
                share[lo:hi] = (yes / all_).take(w, mode="clip")
            else:
                share[lo:hi] = yes.take(w, mode="clip") / all_.take(w, mode="clip")
            if 8 * (hi - lo) > len(all_):
                all_ += np.bincount(w, minlength=len(all_))
                yes += np.bincount(w, a, minlength=len(all_))
            else:
                np.add.at(all_, w, 1.0)
                np.add.at(yes, w, a.astype(np.float64))
        logs = np.empty(len(first))
        for lo in range(0, len(first), SLICE):
            s = slice(lo, lo + SLICE)
            p = share[s] * LAST
            p += (1 - LAST) * first[s]
            p -= 1 - answers[s]
            logs[s] = np.log(np.abs(p, out=p).astype(np.float32))
        rows, turn = row[order], block[order]
        new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (turn[1:] != turn[:-1]))))
        return np.bincount(rows[new], np.add.reduceat(logs, turned[new]), minlength=n) / -np.log(2), np.stack((all_, yes))
