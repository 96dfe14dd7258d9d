"""Removal of repeated passages: anchored fingerprint refinement, in place of a merge of shards' transforms.

The merge of Burrows-Wheeler transforms is in bwt_merge; a round of it moves every suffix by one symbol, which takes far too long
at 400 symbols (figures in the README). This module finds the same intervals, those of strings of the window's length that
repeat, from a sample of suffixes and by whole depths.

Which suffixes. Every string of `window` bytes is reached from a few suffixes. The k-grams of a text are hashed, and a
window's anchor is the least hash among its first `span` k-grams (the first, if tied). An anchor depends on the window's own
bytes only, so equal windows have equal anchors at equal places. The suffixes that start at anchors are one in about span / 2
bytes; the windows that share an anchor are a stretch of consecutive starts. Each stretch is a row: the hash of the `depth` bytes
after its anchor, which all its windows hold, and the hash of all that its windows hold.

Refinement. At each depth, intervals of suffixes that agree up to it are counted: an interval of one suffix is settled
(nothing repeats) and leaves; suffixes of an interval that agree to both sides, as far as their windows reach, are
settled too (all their windows repeat); only torn intervals, which hold suffixes that differ somewhere, one of them
single, go on to the next depth, with one suffix for each kind. Only interval sizes are exchanged, combined in each
task before they are shuffled. The depths are `depth` bytes for whole stretches; then, for blocks of BLOCK windows counted
from the anchor, what the block's windows have in common; then each window of its own. Equality is by two independent
64-bit hashes.

Defined results: null text is the empty text; texts shorter than the window lose nothing; rows that repeat a text are
repeats of each other (both lose what they share, as the contract's "starts anywhere else" says), also with the same or a null doc_id;
overlapping occurrences within one text count; an empty table gives no rows; other columns are not read. Very long texts
are cut into overlapping parts of PART bytes, which changes stretches but no result. Passages of over 50 words are sought by strings
of 200 bytes, and words are split by ASCII white space: more than 50 words of one or two letters in fewer bytes are not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytewords as B
from .common import drop, free_names, fresh, map_arrow, map_rows, squeezed, stage

WINDOW = 400
#: A passage is a run covered by repeated strings of so many bytes that holds more words than that: 51 words of three
#: letters and a space have 203 bytes.
PASSAGE_WINDOW, PASSAGE_WORDS = 200, 50
GRAM = 16
BLOCK = 16
PART = 1 << 20

BASE = 0x9FB21C651E98DF25
INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = B.stream(256, 9)


@dataclass(frozen=True)
class Form:
    """Bytes of a window; span, the k-grams that its anchor is sought in (the largest power of two up to two thirds of the
    window; span + GRAM is less than the window); and depth, the bytes that all windows of an anchor hold to its right."""

    window: int

    def __post_init__(self):
        if self.window < 4 * GRAM:
            raise ValueError(f"windows have {4 * GRAM} bytes at least")

    @property
    def span(self) -> int:
        return 1 << (2 * self.window // 3).bit_length() - 1

    @property
    def depth(self) -> int:
        return self.window - self.span + 1


class Prefixes:
    """Hashes of any substring of a byte array, from one running sum of a polynomial."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * B.powers_for(n)[:n], out=self.sums[1:])
        self.back = B.powers(len(B.powers_for(n + 1)), INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return B.mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def parts(texts: B.Texts, window: int = WINDOW):
    """(row of each text or part, Texts whose rows are parts, start of each part, last window start + 1 in each part)."""
    size = int(texts.offsets[-1])
    if size <= PART + window:
        starts = np.zeros(texts.n, np.int64)
        stops = np.maximum(np.diff(texts.offsets) - window + 1, 0)
        yield np.arange(texts.n), texts, starts, stops
        return
    for row in range(texts.n):
        data = texts.data[texts.offsets[row] : texts.offsets[row + 1]]
        for start in range(0, max(len(data) - window + 1, 1), PART):
            piece = data[start : start + PART + window - 1]
            yield np.array([row]), B.Texts(0, piece, np.array([0, len(piece)])), np.array([start]), np.array([max(len(piece) - window + 1, 0)])


def anchors(hashes: Prefixes, n: int, span: int) -> np.ndarray:
    """For each byte place from which span k-grams start, the place of the least k-gram hash."""
    at = np.arange(n - GRAM + 1)
    least = (hashes.of(at, at + GRAM) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    width = 1
    while width < span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def stretches(texts: B.Texts, stops: np.ndarray, hashes: Prefixes, span: int) -> tuple[np.ndarray, ...]:
    """(row, first window start, last window start, anchor) of each stretch; places in the chunk."""
    none = np.zeros(0, np.int64)
    if not stops.sum():
        return none, none, none, none
    row = np.repeat(np.arange(texts.n), stops)
    start = np.arange(len(row)) - np.repeat(np.cumsum(stops) - stops, stops) + np.repeat(texts.offsets[:-1], stops)
    anchor = anchors(hashes, len(texts.data), span)[start]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(row) - 1]))
    return row[first], start[first], start[last], anchor[first]


SUFFIXES = "row long, first int, windows int, lead int, prefix long, symbol long"
_ARROW = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("lead", pa.int32()), ("prefix", pa.int64()), ("symbol", pa.int64())])


def row_key(doc_id: str, text: str):
    """A key that only rows of the same doc_id and text share: they have the same result."""
    return F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("row"))


def anchored_stretches(rows: DataFrame, form: Form) -> DataFrame:
    """Each stretch: its row, place and anchor, and the hashes of what its windows have in common (prefix) and hold in all (symbol).
    rows: row and text."""

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in B.chunks(batch.column(1)):
                for origin, piece, begin, stops in parts(texts, form.window):
                    if not stops.sum():
                        continue
                    hashes = Prefixes(piece.data)
                    row, first, last, anchor = stretches(piece, stops, hashes, form.span)
                    prefix = hashes.of(anchor, anchor + form.depth)
                    reach = (anchor - first) * form.span + (last - first)
                    symbol = B.mix(hashes.of(first, anchor) * np.uint64(3) + hashes.of(anchor, last + form.window) * np.uint64(5) + reach.astype(np.uint64))
                    columns = [key[texts.first + origin[row]], (first - piece.offsets[row] + begin[row]).astype(np.int32), (last - first + 1).astype(np.int32), (anchor - first).astype(np.int32), prefix.view(np.int64), symbol.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_ARROW)

    return map_arrow(rows, run, SUFFIXES)


def refine(members: DataFrame, interval: list[str], kind: str, one: list[str], held: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One round. members have the columns of interval, kind, one and copies (how many suffixes each stands for, 2
    meaning more). Returns the kinds that occur twice or more (interval, kind), all of whose windows repeat, and one
    member of each kind of the torn intervals, with copies. Tables written for that join held."""
    kinds = stage(members.groupBy(*interval, kind).agg(F.sum("copies").alias("copies"), F.min(F.struct(*one)).alias("one")), "kinds")
    # Written, here and below, so that both sides of a join are read from shuffles and a frequent key can be split.
    torn = stage(kinds.groupBy(*interval).agg(F.count("*").alias("n"), F.min("copies").alias("least")).where("n > 1 AND least = 1").select(*interval), "torn")
    held += [kinds, torn]
    asked = kinds.join(torn, interval, "left_semi").select(*interval, "one.*", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    return kinds.where("copies > 1").select(*interval, kind), asked


def stretch_bytes(docs: DataFrame, asked: DataFrame, form: Form) -> DataFrame:
    """asked (row, first, windows, lead, prefix, copies) with the bytes of each stretch. docs: row and text."""
    lists = asked.groupBy("row").agg(F.collect_list(F.struct("first", "windows", "lead", "prefix", "copies")).alias("asked"))
    schema = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("windows", pa.int32()), ("lead", pa.int32()), ("prefix", pa.int64()), ("copies", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                data, wanted = unpack(batch.column(1)[i].as_py()), batch.column(2)[i].values
                first, windows = (wanted.field(j).to_pylist() for j in (0, 1))
                cut = pa.array([data[a : a + n + form.window - 1] for a, n in zip(first, windows)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), batch.column(0)[i].as_py())), *(wanted.field(j) for j in range(5)), cut], schema=schema)

    joined = squeezed(docs, "text").join(lists, "row").dropDuplicates(["row"]).select("row", "text", "asked")
    return map_arrow(joined, run, "row long, first int, windows int, lead int, prefix long, copies int, bytes binary")


def blocks(torn: DataFrame, form: Form) -> DataFrame:
    """For each stretch, its blocks: windows whose anchor is t bytes on, t div BLOCK = block. core: hash of what all windows of
    such a block hold; hull: of all that the stretch's own windows in it hold."""

    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("block", pa.int32()), ("start", pa.int32()), ("windows", pa.int32()), ("prefix", pa.int64()), ("copies", pa.int32()), ("core", pa.int64()), ("hull", pa.int64())])
        for batch in batches:
            row, first, windows, lead, prefix, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            # Stretches stand one after another in one array of bytes.
            text = batch.column(6).cast(pa.large_binary())
            for texts in B.chunks(text):
                s = slice(texts.first, texts.first + texts.n)
                hashes, base = Prefixes(texts.data), texts.offsets[:-1]
                most, least = lead[s] // BLOCK, (lead[s] - windows[s] + 1) // BLOCK
                count = (most - least + 1).astype(np.int64)
                i = np.repeat(np.arange(texts.n), count)
                block = most[i] - (np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count))
                anchor = base[i] + lead[s][i]
                high = np.minimum(block * BLOCK + BLOCK - 1, lead[s][i])
                low = np.maximum(block * BLOCK, lead[s][i] - windows[s][i] + 1)
                core = hashes.of(anchor - block * BLOCK, anchor - block * BLOCK - BLOCK + 1 + form.window)
                hull = B.mix(hashes.of(anchor - high, anchor - low + form.window) + (high * form.span + low).astype(np.uint64))
                start = (first[s][i] + lead[s][i] - high).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row[s][i]), pa.array(first[s][i]), pa.array(block.astype(np.int32)), pa.array(start), pa.array((high - low + 1).astype(np.int32)), pa.array(prefix[s][i]), pa.array(copies[s][i]), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], schema=schema)

    return map_arrow(torn.select("row", "first", "windows", "lead", "prefix", "copies", "bytes"), run, "row long, first int, block int, start int, windows int, prefix long, copies int, core long, hull long")


def single_windows(torn: DataFrame, asked: DataFrame, form: Form) -> DataFrame:
    """One row for each window of the blocks asked for: core, window (hash), row, at, copies."""

    def run(batches):
        schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("copies", pa.int32()), ("core", pa.int64()), ("window", pa.int64())])
        for batch in batches:
            row, offset, start, windows, copies, core = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            for texts in B.chunks(batch.column(6).cast(pa.large_binary())):
                s = slice(texts.first, texts.first + texts.n)
                count = windows[s].astype(np.int64)
                i = np.repeat(np.arange(texts.n), count)
                step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                place = texts.offsets[:-1][i] + offset[s][i] + step
                found = Prefixes(texts.data).of(place, place + form.window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row[s][i]), pa.array((start[s][i] + step).astype(np.int32)), pa.array(copies[s][i]), pa.array(core[s][i]), pa.array(found)], schema=schema)

    joined = torn.select("row", "first", "bytes").join(asked, ["row", "first"])
    return map_arrow(joined.select("row", (F.col("start") - F.col("first")).alias("offset"), "start", "windows", "copies", "core", "bytes"), run, "row long, at int, copies int, core long, window long")


def repeated_spans(docs: DataFrame, window: int, held: list[DataFrame]) -> DataFrame:
    """row and spans: byte ranges (start, end), in no order, that cover exactly the repeated windows. docs: row and text. The result
    reads written tables, which join held: they may be dropped once it is written itself."""
    form = Form(window)
    covered = lambda df: df.select("row", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    # Depth one: whole stretches.
    suffixes = stage(anchored_stretches(docs, form), "suffixes")
    shared = stage(suffixes.groupBy("prefix").agg(F.count("*").alias("size")).where("size > 1").select("prefix"), "shared")
    active = stage(suffixes.join(shared, "prefix", "left_semi").withColumn("copies", F.lit(1)), "intervals")
    drop(suffixes)
    whole, asked = refine(active, ["prefix"], "symbol", ["row", "first", "windows", "lead"], held)
    spans = covered(active.join(whole, ["prefix", "symbol"], "left_semi").withColumn("start", F.col("first")).withColumn("end", F.col("first") + F.col("windows") + window - 1))
    torn = stage(stretch_bytes(docs, asked, form), "torn")
    # Depth two: blocks of windows.
    members = stage(blocks(torn, form), "blocks")
    interval = ["prefix", "block", "core"]
    whole, asked = refine(members, interval, "hull", ["row", "first", "start", "windows"], held)
    spans = spans.unionByName(covered(members.where("copies = 1").join(whole, [*interval, "hull"], "left_semi").withColumn("end", F.col("start") + F.col("windows") + window - 1)))
    # Depth three: single windows.
    windows = stage(single_windows(torn, asked.select("row", "first", "start", "windows", "copies", "core"), form), "windows")
    equal = stage(windows.groupBy("core", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("core", "window"), "equal")
    spans = spans.unionByName(covered(windows.where("copies = 1").join(equal, ["core", "window"], "left_semi").withColumn("start", F.col("at")).withColumn("end", F.col("at") + window)))
    drop(torn)
    held += [shared, active, members, windows, equal]
    return spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.concatenate((first[1:] - 1, [len(start) - 1]))] if len(start) else end


def cut(docs: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """The runs that spans cover, of `least` bytes or more, as texts of their own: piece (a key), row, base and text (bytes)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row, text, found in zip(*(batch.column(i) for i in range(3))):
                start, end = merged(*(found.values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2)))
                held = np.flatnonzero(end - start >= least)
                if len(held):
                    data = unpack(text.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(held), pa.int64()), pa.array(start[held].astype(np.int32)), pa.array([data[a:b] for a, b in zip(start[held], end[held])], pa.binary())], names=["row", "base", "text"])

    return map_arrow(squeezed(docs, "text").join(spans, "row").select("row", "text", "spans"), run, "row long, base int, text binary").select(F.xxhash64("row", "base").alias("piece"), "row", "base", "text")


def finer_spans(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """repeated_spans for a longer window, from those of a shorter one: a repeated string lies in what its parts cover, so
    that only the covered runs of `window` bytes or more are read."""
    pieces = stage(cut(docs, spans, window), "pieces")
    found = repeated_spans(pieces.select(F.col("piece").alias("row"), "text"), window, []).withColumnRenamed("row", "piece")
    placed = found.join(pieces.select("piece", "row", "base").distinct(), "piece").select("row", F.explode("spans").alias("span"), "base")
    return placed.groupBy("row").agg(F.collect_set(F.struct((F.col("span.start") + F.col("base")).alias("start"), (F.col("span.end") + F.col("base")).alias("end"))).alias("spans"))


NAMES = ("n_bytes", "n_removed", "n_spans", "kept")


def removal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, ...] | None = None, decoded: bool = False, window: int = WINDOW, words: int = 0, passages: bool = False) -> DataFrame:
    """keep (all columns but the text by default) with the text's bytes, removed bytes, removed runs and remaining bytes, or these
    decoded, without what is left of a cut character. Only runs of more than `words` words are removed.

    passages: also the number and bytes of passages, runs covered by repeated strings of PASSAGE_WINDOW bytes that hold
    more than PASSAGE_WORDS words; they are counted, not removed. names: of the new columns, by default NAMES (and
    n_passages, passage_bytes), with underscores before a name that keep has.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if text in keep:
        raise ValueError("the text itself is returned as what is kept of it")
    given = (*NAMES, "n_passages", "passage_bytes") if passages else NAMES
    names = free_names(keep, *given) if names is None else names
    row, found, short = fresh(docs, "_row"), fresh(docs, "_spans"), fresh(docs, "_short")
    keyed = docs.select(row_key(doc_id, text).alias("row"), F.col(f"`{text}`").alias("text"))
    if passages and PASSAGE_WINDOW < window:
        held: list[DataFrame] = []
        shorter = stage(repeated_spans(keyed, PASSAGE_WINDOW, held), "spans")
        drop(*held)
        spans = shorter.withColumnRenamed("spans", short).join(finer_spans(keyed, shorter, window).withColumnRenamed("spans", found), "row", "left")
    elif passages:
        raise ValueError(f"passages are counted beside windows of more than {PASSAGE_WINDOW} bytes")
    else:
        spans = repeated_spans(keyed, window, []).withColumnRenamed("spans", found)
    needed = list(dict.fromkeys([*keep, doc_id, text]))
    whole = squeezed(docs.select(*(f"`{c}`" for c in needed)).withColumn(row, row_key(doc_id, text)), text)
    of_row = [short, found] if passages else [found]
    joined = whole.join(spans.withColumnRenamed("row", row), row, "left").select(*(f"`{c}`" for c in dict.fromkeys([*keep, text])), *of_row)
    place = joined.columns.index(text)
    at = [joined.columns.index(c) for c in of_row]

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def runs(data, spans, words):
            if spans is None or not len(spans):
                return []
            start, end = merged(*(spans.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(2)))
            return [(a, b) for a, b in zip(start.tolist(), end.tolist()) if not words or len(data[a:b].split()) > words]

        def work(batch):
            out = []
            for i, value in enumerate(batch.column(place)):
                data = unpack(value.as_py()) if value.is_valid else b""
                spans = [batch.column(j)[i] for j in at]
                spans = [s.values if s.is_valid else None for s in spans]
                gone = runs(data, spans[-1], words)
                left = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)]))
                said = runs(data, spans[0], PASSAGE_WORDS) if passages else []
                out.append((len(data), sum(b - a for a, b in gone), len(gone), left, len(said), sum(b - a for a, b in said)))
            counts = [pa.array([f[j] for f in out], pa.int64()) for j in (0, 1, 2, 4, 5)]
            kept = pa.array([f[3].decode("utf-8", "ignore") for f in out], pa.string()) if decoded else pa.array([f[3] for f in out], pa.binary())
            return [*counts[:3], kept, *(counts[3:] if passages else [])]

        return work

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType() if decoded else T.BinaryType(), T.LongType(), T.LongType()]
    return map_rows(joined, keep, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]), make)


def digest(removed: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passages and passage_bytes if counted."""
    more = [c for c in ("n_passages", "passage_bytes") if c in removed.columns]
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), *more)


def remove_repeats(docs: DataFrame, window: int = PASSAGE_WINDOW, words: int = PASSAGE_WORDS) -> DataFrame:
    """The documents without repeated passages: runs covered by strings of `window` bytes that stand elsewhere too, of more
    than `words` words. Texts that end up empty stay as rows, n_chars follows the text where one was removed, and null texts
    become empty."""
    prefix = "_kept"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    names = tuple(f"{prefix}_{x}" for x in ("bytes", "removed", "spans", "text"))
    out = removal(docs, names=names, decoded=True, window=window, words=words).withColumn("text", F.col(names[3]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(names[1]) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*(f"`{c}`" for c in docs.columns))
