"""Packing by cutting-stock column generation.

Documents become token ids by the given tokenizer, each followed by an end id, and are cut into pieces: whole
sequences, then what is left down to a multiple of GRID tokens, then the tail below GRID. So pieces have at most
capacity / GRID + GRID distinct lengths, at any number of documents. Their histogram (the only thing that reaches the driver) states a
cutting-stock problem: a linear program over patterns, solved by column generation with a revised simplex, whose columns
are priced by a knapsack dynamic program; pattern counts are rounded down and what is left is filled largest first. Pieces
are ranked within their length, in salted groups, and a rank's pattern, copy and place follow by arithmetic.

Defined results: null and empty texts are their end id alone, one piece; repeated rows are packed each for itself; an
empty table gives no rows; texts of any length are cut, none is shortened; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords as B
from .common import map_arrow, stage

CAPACITY = 4096
GRID = 32
END_ID = 2
#: Distinct parts of words whose ids a generation of a worker's memory holds.
CACHED_PARTS = 400_000
CHUNK_BYTES = 3 << 20

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of whole texts through a bounded memory of the ids of their parts.

    The tokenizer drops white space and case, no token spans white space, and none spans an ASCII letter or digit and
    punctuation after it. So a text is cut into words, and words into stem and closing punctuation; a chunk's distinct
    parts (told apart by 64-bit hashes, within the chunk alone) are looked up or encoded once, and ids are gathered by
    array operations. Unknown parts are encoded together, between marks that they do not hold. Chunks that could hold a
    special token are encoded text by text.
    """

    TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
    MARK = b"\x01"

    def __init__(self, path: str, limit: int = CACHED_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.young, self.old = Tokenizer.from_file(path), limit, {}, {}
        (self.mark,) = self.tokenizer.encode(self.MARK.decode(), add_special_tokens=False).ids
        self.closing = np.isin(np.arange(256), list(self.TAIL))
        self.alnum = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])

    def parts(self, texts: B.Texts) -> B.Words:
        """Words, those that end in punctuation after an ASCII letter or digit in two parts."""
        found = B.words(texts, B.SPACES)
        if not len(found.starts):
            return found
        last = np.where(self.closing[texts.data], -1, np.arange(len(texts.data))).astype(np.int32 if len(texts.data) < 1 << 31 else np.int64)
        np.maximum.accumulate(last, out=last)
        stem = last[found.ends - 1] + 1
        two = (stem > found.starts) & (stem < found.ends)
        two[two] = self.alnum[texts.data[stem[two] - 1]]
        # Parts stand one after another, so sorted starts and sorted ends belong together.
        starts = np.sort(np.concatenate((found.starts, stem[two])))
        ends = np.sort(np.concatenate((found.ends, stem[two])))
        return B.Words(starts, ends, np.searchsorted(starts, texts.offsets))

    def look_up(self, parts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each part. What was not asked for in two generations is forgotten."""
        out = [self.young.get(p) for p in parts]
        missing = [i for i, ids in enumerate(out) if ids is None]
        if len(self.young) + len(missing) > self.limit:
            self.young, self.old = {}, self.young
        new = []
        for i in missing:
            out[i] = self.old.get(parts[i])
            if out[i] is None:
                new.append(i)
        together = [i for i in new if self.MARK not in parts[i]]
        for i in set(new).difference(together):
            out[i] = np.array(self.tokenizer.encode(parts[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        for lo in range(0, len(together), 512):
            some = together[lo : lo + 512]
            ids = np.array(self.tokenizer.encode(b" \x01 ".join([parts[i] for i in some]).decode(), add_special_tokens=False).ids, "<u4")
            packed, start = ids.tobytes(), 0
            for i, end in zip(some, [*np.flatnonzero(ids == self.mark).tolist(), len(ids)], strict=True):
                out[i] = packed[4 * start : 4 * end]
                start = end + 1
        self.young.update((parts[i], out[i]) for i in missing)
        return out

    def encode(self, texts: B.Texts) -> tuple[bytes, np.ndarray]:
        """All ids of a chunk, and where each row's begin among them (one more at the end)."""
        raw = texts.data.tobytes()
        if b"<|" in raw:
            rows = [np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4") for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
            return b"".join(r.tobytes() for r in rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        found = self.parts(texts)
        if not len(found.starts):
            return b"", np.zeros(texts.n + 1, np.int64)
        _, first, each = np.unique(B.word_hashes(texts, found), return_index=True, return_inverse=True)
        low = raw.lower()
        ids = self.look_up([low[a:b] for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist())])
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        begin = np.cumsum(sizes) - sizes
        size = sizes[each]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin[each] - total[:-1], size) + np.arange(total[-1])
        return np.frombuffer(b"".join(ids), "<u4")[at].tobytes(), total[found.rows]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut(total: int, capacity: int = CAPACITY, grid: int = GRID) -> list[int]:
    """Lengths of a document's pieces in order."""
    whole, left = divmod(total, capacity)
    main, tail = left // grid * grid, left % grid
    return [capacity] * whole + [x for x in (main, tail) if x]


def tokenize_and_cut(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. Ids themselves are not kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memory = word_ids(tokenizer_path)
        for batch in batches:
            origin, rows = [], []
            for texts in B.chunks(batch.column(1), CHUNK_BYTES):
                ids, bounds = memory.encode(texts)
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), texts.first):
                    total, start = hi - lo + 1, 0
                    for length in cut(total):
                        stop = min(lo + start + length, hi)
                        crc = zlib.crc32(ids[4 * (lo + start) : 4 * stop])
                        origin.append(i)
                        rows.append((start, length, zlib.crc32(end, crc) if start + length == total else crc, total))
                        start += length
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(origin, pa.int64())), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack's best value and its item counts.

    For each item, best[c] = max over k of best[c - k * w] + k * v is a running maximum along residues modulo w.
    """
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1, dtype=np.int64)
    for i in np.argsort(-values / lengths):
        v, w = values[i], int(lengths[i])
        if v <= 0:
            break
        rows = -(-(capacity + 1) // w)
        grid = np.full(rows * w, -np.inf)
        grid[: capacity + 1] = best
        slope = np.repeat(np.arange(rows) * v, w)
        run = np.maximum.accumulate((grid - slope).reshape(rows, w), axis=0).ravel() + slope
        better = run[: capacity + 1] > best + 1e-12
        best[better] = run[: capacity + 1][better]
        taken[better] = i
    counts, c = np.zeros(len(lengths)), int(np.argmax(best))
    # An entry's last item is right for it, but what is left may have been bettered by later items: follow it anew.
    value = float(best[c])
    while c > 0 and taken[c] >= 0:
        counts[taken[c]] += 1
        c -= int(lengths[taken[c]])
    return value, counts


def linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in a least fractional cover of the demand."""
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for turn in range(rounds):
        duals = inverse.sum(axis=0)
        _, column = price(duals, lengths, capacity)
        # The least cover is no less than x.sum() over the best column's value: half a sequence from it is near enough.
        value = duals @ column
        if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) < 0.5:
            break
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        ratio = x[up] / step[up]
        leave = int(up[np.argmin(ratio)])
        basis[:, leave] = column
        if turn % 200 == 199:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leave] / step[leave]
            inverse -= np.outer(step, row)
            inverse[leave] = row
        x = np.maximum(inverse @ demand, 0)
    return basis, x


def patterns(lengths: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: pieces a sequence}) whose sums are the demand exactly."""
    size, left = np.array(lengths, np.int64), np.array(demand, np.int64)
    out: list[tuple[int, dict[int, int]]] = []

    def use(times: int, counts: np.ndarray) -> None:
        out.append((times, {int(size[i]): int(counts[i]) for i in np.flatnonzero(counts)}))
        left[:] -= times * counts

    if len(size):
        columns, x = linear_program(size, left.astype(float), capacity)
        for j in np.argsort(-x):
            counts = np.rint(columns[:, j]).astype(np.int64)
            held = counts > 0
            times = min(int(np.floor(x[j] + 1e-9)), int((left[held] // counts[held]).min())) if held.any() else 0
            if times > 0:
                use(times, counts)
    order = np.argsort(-size)
    while left.sum():
        counts, room = np.zeros(len(size), np.int64), capacity
        for i in order:
            counts[i] = min(left[i], room // size[i])
            room -= int(counts[i] * size[i])
        held = counts > 0
        use(int((left[held] // counts[held]).min()), counts)
    return out


def layout(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset) for each length of each pattern."""
    rows, ranks, sequence = [], {}, 0
    for times, counts in found:
        offset = 0
        for length in sorted(counts, reverse=True):
            first = ranks.get(length, 0)
            ranks[length] = first + times * counts[length]
            rows.append((length, first, ranks[length], sequence, counts[length], offset))
            offset += length * counts[length]
        sequence += times
    return rows


def ranked(pieces: DataFrame, groups: int) -> DataFrame:
    """pieces with their rank (from 0) within their length, without a task that holds a whole length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return salted.withColumn("place", place).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("salt", "place", "before")


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    spark = docs.sparkSession
    pieces = stage(tokenize_and_cut(docs, tokenizer_path, doc_id=doc_id, text=text), "pieces")
    histogram = sorted((r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect())
    rows = layout(patterns([x for x, _ in histogram], [n for _, n in histogram], capacity))
    table = spark.createDataFrame(rows, "length long, first long, end long, sequence long, each long, at long")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The table has a row for each length of each pattern, bounded by the square of the number of lengths.
    placed = ranked(pieces, groups).alias("p").join(F.broadcast(table.alias("t")), F.expr("p.length = t.length and p.rank >= t.first and p.rank < t.end"))
    return placed.select(
        "doc_id",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        "doc_tokens",
        F.expr("t.sequence + (p.rank - t.first) div t.each").alias("sequence_id"),
        F.expr("t.at + (p.rank - t.first) % t.each * t.length").alias("offset"),
    )
