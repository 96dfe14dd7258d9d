"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

Normal form: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, one space between words. Each item gives its
windows of ten consecutive words (an item of fewer words, but not none, is one window). The automaton's symbols are words,
numbered, so that a window has ten nodes at most whatever its length in bytes; a text's words are looked up in the same
numbering and scanned once. Hits are word numbers, which are mapped to byte offsets of the original text.

Windows are made and counted in executors, one row for each window and item that has it, so that a window of very many items
is many rows. More than BLOCK_WINDOWS windows are first cut down to those that occur: a filter of FILTER bits, whatever their number,
goes over the documents' own windows once, and what passes it is joined with the table of windows by hash. Those that occur are
one automaton, or, if they or their items are still too many for one, as many as the count asks for, which pass through the driver one
after another, each in one narrow pass over the documents that writes the rows with hits. So the number of passes does not grow
with the windows but with those that the documents hold, and neither the driver nor a worker ever holds more than one block.

Defined results: null or wordless texts have no words and no hits; null or wordless items give no window; rows that
repeat an item_id are one item, a null item_id is the item "null"; repeated documents are scanned each for itself; an
empty table of items leaves every document clean; of a document's other columns none is read.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as B
from .common import drop, free_names, fresh, map_arrow, map_rows, stage

WINDOW_WORDS = 10
#: Distinct windows in one automaton: ten nodes each, some 100 bytes a node.
BLOCK_WINDOWS = 100_000
#: Pairs of a window and an item in one automaton.
BLOCK_PAIRS = 500_000
#: Bits of the filter, and the segments in which tasks hand it over.
FILTER, SEGMENTS = 1 << 27, 64

_FORM = bytes(0x20 if b in B.NON_ALNUM else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_FORM).split()


def windows(text: bytes, size: int = WINDOW_WORDS) -> set[bytes]:
    """The distinct windows of an item, in normal form."""
    found = normal_words(text)
    if not found:
        return set()
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))}


class Machine:
    """The automaton of a block: windows, each with the numbers of the items that have it, and the items' names."""

    def __init__(self, block: tuple[dict[bytes, list[int]], list[str]]):
        windows, self.names = block
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if windows else None
        for window, owners in windows.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.split(b" "))
            self.automaton.add_word(key, (len(key), owners))
        shortest = min((window.count(b" ") + 1 for window in windows), default=1)
        # A hit lies in a run of words that windows have, of as many words as the shortest window at least.
        self.runs = re.compile(rb"\x01{%d,}" % shortest)
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Word count, merged runs [first, last + 1) of hit words, and names of the items with a window in the text."""
        split = normal_words(text)
        known = list(map(self.numbers.get, split))
        starts, stops, held, names = [], [], set(), set()
        for run in self.runs.finditer(bytes([n is not None for n in known])):
            first = run.start() + 1
            for end, (size, owners) in self.automaton.iter(tuple(known[run.start() : run.end()])):
                starts.append(first + end - size)
                stops.append(first + end)
                if id(owners) not in held:
                    held.add(id(owners))
                    names.update(owners)
        return len(split), merge(np.array(starts), np.array(stops)) if starts else [], {self.names[n] for n in names}


def merge(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open runs as maximal disjoint runs."""
    order = np.argsort(starts, kind="stable")
    starts, stops = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(stops)[order])
    new = np.concatenate(([True], starts[1:] > stops[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return list(zip(starts[new].tolist(), stops[last].tolist()))


def window_hashes(column: pa.Array, size: int) -> np.ndarray:
    """Hashes of all runs of size words of the rows, and of rows with fewer words, but not none, of all their words."""
    out = [np.zeros(0, np.uint64)]
    for texts in B.chunks(column):
        found = B.words(texts, B.NON_ALNUM)
        out.append(B.shingle_hashes(B.word_hashes(texts, found), found.rows, size)[0])
    return np.concatenate(out)


def window_table(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """window (bytes), hash, words and name: one row for each distinct window and item that has it, written."""
    slim = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name"), F.col(text).alias("text")).where("text is not null")

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                found = list(windows(text.as_py().encode(), size))
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    column = pa.array(part, pa.binary())
                    words = [w.count(b" ") + 1 for w in part]  # a window is a row of at most size words: it has one hash
                    yield pa.RecordBatch.from_arrays([column, pa.array(window_hashes(column, size).view(np.int64)), pa.array(words, pa.int32()), pa.array([name.as_py()] * len(part))], names=["window", "hash", "words", "name"])

    return stage(map_arrow(slim, run, "window binary, hash long, words int, name string").distinct(), "windows")


def window_filter(table: DataFrame) -> np.ndarray:
    """FILTER bits as bytes: those at the hashes of a table's windows are set. Tasks hand over what they set, packed, by segment."""

    def own(batches):
        bits = np.zeros(FILTER // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if bits.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array([pack(p.tobytes()) for p in bits.reshape(SEGMENTS, -1)], pa.binary())], names=["segment", "bits"])

    def both(batches):
        unpack, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for segment, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(unpack(bits.as_py()), np.uint8)
                sums[segment] = sums[segment] | part if segment in sums else part
        if sums:
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(v.tobytes()) for v in sums.values()], pa.binary())], names=["segment", "bits"])

    parts = map_arrow(table.select("hash").distinct(), own, "segment int, bits binary").repartition(SEGMENTS, "segment")
    out, unpack = np.zeros((SEGMENTS, FILTER // 8 // SEGMENTS), np.uint8), zstandard.ZstdDecompressor().decompress
    for r in map_arrow(parts, both, "segment int, bits binary").collect():  # FILTER bits at most
        out[r["segment"]] = np.frombuffer(unpack(r["bits"]), np.uint8)
    return out.reshape(-1)


def occurring(table: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The rows of a table of windows whose hash some document's window has, written: all windows that occur are among them."""
    sizes = sorted(r["words"] for r in table.select("words").distinct().collect())  # at most as many as a window has words
    shared = docs.sparkSession.sparkContext.broadcast(window_filter(table))

    def run(batches):
        bits = shared.value
        for batch in batches:
            for size in sizes:
                hashes = window_hashes(batch.column(0), size)
                at = hashes % np.uint64(FILTER)
                hashes = np.unique(hashes[(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0])
                if len(hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["hash"])

    slim = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    out = stage(table.join(map_arrow(slim, run, "hash long").distinct(), "hash", "left_semi").select(*table.columns), "occurring")
    drop(table)
    shared.destroy()
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def found_columns(column: pa.Array, results: list[tuple[int, list[tuple[int, int]], set[str]]]) -> list[pa.Array]:
    """The new columns of texts, of what was found in each."""
    word_runs, byte_runs = [], []
    for i, (_, runs, _) in enumerate(results):
        bounds = B.words(next(B.chunks(column.slice(i, 1))), B.NON_ALNUM) if runs else None
        word_runs.append([{"start": a, "end": b} for a, b in runs])
        byte_runs.append([{"start": int(bounds.starts[a]), "end": int(bounds.ends[b - 1])} for a, b in runs])
    return [pa.array([n for n, _, _ in results], pa.int64()), pa.array(word_runs, _SPANS), pa.array(byte_runs, _SPANS), pa.array([sorted(names) for *_, names in results], pa.list_(pa.string()))]


def block_hits(docs: DataFrame, text: str, shared) -> DataFrame:
    """key (of a text), runs of hit words, and names, of the texts with hits in one block."""

    def run(batches):
        machine = Machine(shared.value)
        for batch in batches:
            found = [(key, machine.scan(t.as_py().encode())) for key, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            found = [f for f in found if f[1][1]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([[{"start": a, "end": b} for a, b in r] for _, (_, r, _) in found], _SPANS), pa.array([sorted(n) for _, (*_, n) in found], pa.list_(pa.string()))], names=["key", "runs", "names"])

    slim = docs.select(text_key(text).alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    return map_arrow(slim, run, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("runs", SPANS), T.StructField("names", T.ArrayType(T.StringType()))])).dropDuplicates(["key"])


def text_key(text: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, size: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS, block_pairs: int = BLOCK_PAIRS, prefix: str = "") -> DataFrame:
    """keep (all columns by default) and, under names made of prefix: n_words, hit_words (runs of word numbers), hit_bytes
    (the same runs as byte offsets in the original text) and hit_items (names, sorted as strings); with underscores before a
    name that keep has.

    One block is one narrow pass over the documents. With more, the blocks' hits, one row for each text that has some, are
    joined to the documents by the text's SHA-256.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    names = free_names(keep, *(f"{prefix}{x}" for x in ("n_words", "hit_words", "hit_bytes", "hit_items")))
    fields = T.StructType([T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], SPANS), T.StructField(names[3], T.ArrayType(T.StringType()))])
    table = window_table(items, item_id, item_text, size)
    distinct = lambda t: t.select("window").distinct().count()
    windows_in = distinct(table)
    if windows_in > block_windows:
        table = occurring(table, docs, text)
        windows_in = distinct(table)
    by_window, by_pair = -(-windows_in // block_windows), -(-table.count() // block_pairs)
    n = max(1, by_window, by_pair)
    # An item's share of a frequent window may be in any block: what blocks find is united.
    place_of = F.pmod(F.xxhash64("window", "name") if by_pair > by_window else F.xxhash64("window"), F.lit(n))

    def block(i):
        owners, names = {}, {}
        for r in (table if n == 1 else table.where(place_of == i)).select("window", "name").toLocalIterator():
            owners.setdefault(bytes(r["window"]), []).append(names.setdefault(r["name"], len(names)))
        return spark.sparkContext.broadcast((owners, list(names)))

    if n == 1:
        place, shared = docs.columns.index(text), block(0)

        def make():
            machine = Machine(shared.value)
            return lambda batch: found_columns(batch.column(place), [machine.scan((t.as_py() or "").encode()) for t in batch.column(place)])

        return map_rows(docs, keep, fields, make)
    parts = []
    for i in range(n):
        shared = block(i)
        parts.append(stage(block_hits(docs, text, shared), "hits"))
        shared.destroy()
    key, runs, found = free_names(docs.columns, "_key", "_runs", "_names")
    hits = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias(runs), F.array_distinct(F.flatten(F.collect_list("names"))).alias(found)).withColumnRenamed("key", key)
    needed = list(dict.fromkeys([*keep, text]))
    joined = docs.select(*(f"`{c}`" for c in needed)).withColumn(key, text_key(text)).join(few(hits), key, "left").select(*(f"`{c}`" for c in needed), runs, found)
    place, last = joined.columns.index(text), len(joined.columns) - 1

    def make():
        def work(batch):
            column, results = batch.column(place), []
            for t, r, names in zip(column, batch.column(last - 1).to_pylist(), batch.column(last).to_pylist()):
                results.append((len(normal_words((t.as_py() or "").encode())), merge(*(np.array([x[k] for x in r]) for k in ("start", "end"))) if r else [], set(names or ())))
            return found_columns(column, results)

        return work

    return map_rows(joined, keep, fields, make)


#: Texts with hits up to which they are broadcast to the documents; more are joined by shuffles.
FEW_HITS = 20_000


def few(hits: DataFrame) -> DataFrame:
    hits = stage(hits, "hits")
    return F.broadcast(hits) if hits.limit(FEW_HITS + 1).count() <= FEW_HITS else hits


def digest(found: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without any benchmark window, columns as they were."""
    prefix = fresh(docs, "hit_words").removesuffix("hit_words") + "decon_"
    found = find_contamination(docs, items, prefix=prefix)
    return found.where(F.size(f"{prefix}hit_words") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
