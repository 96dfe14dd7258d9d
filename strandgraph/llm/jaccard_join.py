"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct five-word shingles as 52-bit hashes. Documents with equal sets form a class at once and
are joined as one. Shingles are put in one order for all documents, rarer first; two sets of similarity 0.75 or more share
a shingle among the first n - ceil(0.75 n) + 1 of each. So classes meet on those prefix shingles. The smaller of two sets (each, if
they are equally large) has the shared one even among its first n - ceil(6 n / 7) + 1, its index prefix: the second round only looks at
pairs that meet there. So texts made from one template, each with too many words of its own to link, meet nowhere: their index
prefixes hold nothing but their own words. A pair that meets must pass the length filter, the positional filter (what can still follow the places of the shared shingle), and the suffix
filter (a lower bound on how many members only one of two sets has, from parities: the sets are cut in parts by hash, and a
part that holds an odd number of members in one set and an even number in the other holds a difference; the parts are four
to eight times as many as members, so that few differences fall together); then it is verified once, on whole sets.

The order needs no exact frequencies, any order is right: they come from a sketch of a fixed number of cells. A cell's
count above the middle cell's, which is what rare shingles put into every cell, is the estimate. Groups of near copies would
meet in all pairs. Instead a first round verifies, for each shingle, only the pairs of its most central class (the one whose
shingles are the most frequent) with the others; the links give provisional components. The second round takes all pairs
that meet and are not in one component yet, so no link that could change a component is missed. A shingle whose cell stands
HOT above the middle is dealt over several tasks in the first round, and in the second most of its classes are in one
component, so that only the others meet the rest, block by block, and only where one of the two has it in its index prefix.

Defined results: null, empty and wordless texts have no shingles, no links and their own doc_id as component; a text of
fewer than five words is one shingle; equal texts link, also with one or a null doc_id; a null doc_id is no component id
unless a whole component has no other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from .common import drop, fresh, map_arrow, squeezed, stage, tidy
from .components import components

SHINGLE = 5
#: Similarity as a fraction: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 3, 4
#: Cells of the sketch, and the parts in which tasks hand it over, each one packed row.
SKETCH, SEGMENTS = 1 << 22, 64
#: Bits of a set's parities for each member, at least, and bits of the smallest.
PARITY_BITS, LEAST_BITS = 4, 256
#: Postings of one shingle that one task takes in the first round, by the sketch's estimate.
HOT = 20_000


#: Bits of a shingle's hash; above them stands the row within a chunk, so that one sort of numbers orders all sets.
HASH_BITS = 52
CHUNK_ROWS = 1 << (64 - HASH_BITS)
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)


def shingle_sets(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles, sorted by row and hash, and where each row's begin (one more at the end)."""
    found = B.words(texts, B.SPACES)
    hashes, row = B.shingle_hashes(B.word_hashes(texts, found), found.rows, SHINGLE)
    keys = np.sort((row.astype(np.uint64) << np.uint64(HASH_BITS)) | (hashes & HASH_MASK))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return keys & HASH_MASK, np.searchsorted(keys >> np.uint64(HASH_BITS), np.arange(texts.n + 1, dtype=np.uint64))


def rare_first(often: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row, then frequency (in eighths of powers of two), then hash, of members sorted by row and hash."""
    level = np.minimum(8 * np.log2(1.0 + often), 255).astype(np.uint64)
    keys = np.sort((row.astype(np.uint64) << np.uint64(HASH_BITS)) | (level << np.uint64(HASH_BITS - 8)) | np.arange(len(row), dtype=np.uint64))
    return (keys & np.uint64((1 << (HASH_BITS - 8)) - 1)).astype(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set, of two sums over its members mixed in different ways, and its size. Empty sets: 0."""
    n = np.diff(bounds)
    total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(B.mix(hashes ^ np.uint64(salt))))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    one, two = (t[bounds[1:]] - t[bounds[:-1]] for t in total)
    out = B.mix(one * np.uint64(3) + B.mix(two) + n.astype(np.uint64))
    out[n == 0] = 0
    return out


def parities(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """For each set, a bit for each part: whether an odd number of members falls in it. Empty sets: None."""
    n = np.diff(bounds)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(PARITY_BITS * np.maximum(n, 1))).astype(np.int64)) * (n > 0)
    ends = np.cumsum(bits)
    row = np.repeat(np.arange(len(n)), n)
    place = (ends - bits)[row] + (hashes.astype(np.int64) & (bits[row] - 1))
    packed = np.packbits((np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(e - k) // 8 : e // 8] if k else None for e, k in zip(ends.tolist(), bits.tolist())]


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parities (64-bit words in the last axis) of fewer parts, a power of two of words: halves are combined."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At least so many members are in one of the sets alone, for each row of x."""
    size = min(x.shape[-1], y.shape[-1])
    return np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(axis=-1, dtype=np.int64)


def first_pass(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """kind 0: one row per document: doc_id, its key, signature (null if empty), size and parities. kind 1: a task's part of
    the sketch: its number (key) and counts, packed."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("parity", pa.binary())])

    def run(batches):
        cells = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for texts in B.chunks(batch.column(2), most=CHUNK_ROWS):
                hashes, bounds = shingle_sets(texts)
                np.add.at(cells, cell(hashes), np.uint32(1))
                n, sig = np.diff(bounds), signatures(hashes, bounds).view(np.int64)
                part = batch.slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(texts.n, np.int32)), part.column(0), part.column(1), pa.array(sig, mask=n == 0), pa.array(n.astype(np.int64)), pa.array(parities(hashes, bounds), pa.binary())], schema=schema)
        if cells.any():
            pack, none = zstandard.ZstdCompressor(level=3).compress, pa.nulls(SEGMENTS, pa.int64())
            parts = [pack(part.tobytes()) for part in cells.reshape(SEGMENTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(SEGMENTS, np.int32)), none, pa.array(np.arange(SEGMENTS)), none, none, pa.array(parts, pa.binary())], schema=schema)

    return map_arrow(slim, run, "kind int, doc_id long, key long, sig long, n long, parity binary")


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def sketch(first: DataFrame) -> np.ndarray:
    """Each cell's count above the middle cell's: SKETCH numbers, whatever the input. The tasks' parts are summed by number, and
    come to the driver packed, so that it holds one array of all cells. The middle is that of the parts' medians."""

    def run(batches):
        unpack, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(unpack(part.as_py()), np.uint32)
                sums[key] = sums[key] + found if key in sums else found.astype(np.int64)
        if sums:
            pack = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([int(np.median(v)) for v in sums.values()], pa.int64()), pa.array([pack(v.tobytes()) for v in sums.values()], pa.binary())], names=["key", "middle", "cells"])

    out, unpack = np.zeros((SEGMENTS, SKETCH // SEGMENTS), np.uint32), zstandard.ZstdDecompressor().decompress
    rows = map_arrow(first.where("kind = 1").select("key", "parity").repartition(SEGMENTS, "key"), run, "key long, middle long, cells binary").collect()
    middle = int(np.median([r["middle"] for r in rows])) if rows else 0
    for r in rows:
        out[r["key"]] = np.clip(np.frombuffer(unpack(r["cells"]), np.int64) - middle, 0, (1 << 32) - 1)
    del rows
    tidy()
    return out.reshape(-1)


def prefix_size(n):
    """Members that must be looked at: n less the least overlap with any partner, and one."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def postings(docs: DataFrame, text: str, cells: np.ndarray) -> DataFrame:
    """token, salt, sig, place, n, central: the prefix of each set, once for each task that has it."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("sig", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("central", pa.int32())])

    def run(batches):
        cells, seen = shared.value, set()
        for batch in batches:
            for texts in B.chunks(batch.column(0), most=CHUNK_ROWS):
                hashes, bounds = shingle_sets(texts)
                sig = signatures(hashes, bounds).view(np.int64)
                n = np.diff(bounds)
                fresh = np.array([k > 0 and s not in seen and not seen.add(s) for s, k in zip(sig.tolist(), n.tolist())], bool)
                often = cells[cell(hashes)].astype(np.int64)
                row = np.repeat(np.arange(texts.n), n)
                central = np.concatenate(([0.0], np.cumsum(np.log2(1.0 + often))))
                central = ((central[bounds[1:]] - central[bounds[:-1]]) / np.maximum(n, 1) * 1000).astype(np.int32)
                order = rare_first(often, row)
                place = np.arange(len(row)) - bounds[row]
                held = fresh[row] & (place < prefix_size(n)[row])
                order, row, place = order[held], row[held], place[held]
                token, most = hashes[order].view(np.int64), often[order]
                salt = np.where(most > HOT, sig[row].view(np.uint64) % np.maximum(-(-most // HOT), 1).astype(np.uint64), 0).astype(np.int32)
                for lo in range(0, len(row), 1 << 16):
                    s = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(token[s]), pa.array(salt[s]), pa.array(sig[row[s]]), pa.array(place[s].astype(np.int32)), pa.array(n[row[s]].astype(np.int32)), pa.array(central[row[s]])], schema=schema)

    return map_arrow(docs.select(text), run, "token long, salt int, sig long, place int, n int, central int")


#: Whether a shingle is in a set's index prefix; whether the smaller of two sets (both, if equally large) has it there.
INDEXED_SQL = f"place < n - ceil({2 * NUMERATOR} * n / {NUMERATOR + DENOMINATOR}) + 1"
SMALLER_SQL = "CASE WHEN x_n < y_n THEN x_indexed WHEN x_n > y_n THEN y_indexed ELSE x_indexed AND y_indexed END"
#: Filters of a pair (x, y) that meets on a shingle at places x_place and y_place.
LENGTH_SQL = f"{DENOMINATOR} * least(x_n, y_n) >= {NUMERATOR} * greatest(x_n, y_n)"
POSITION_SQL = f"{NUMERATOR + DENOMINATOR} * bigint(1 + least(x_n - x_place, y_n - y_place) - 1 + least(x_place, y_place)) >= {NUMERATOR} * (x_n + y_n)"


def named(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in columns))


POSTINGS = "token long, salt int, sig long, n int, place int, y_sig long, y_n int, y_place int"


def shared_postings(post: DataFrame) -> DataFrame:
    """The postings of shingles that two classes or more share (or that are salted), once each, and beside each the most
    central class of its shingle and salt. A group ends with its task's sorted stream; salts bound a group's size."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("sig", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("y_sig", pa.int64()), ("y_n", pa.int32()), ("y_place", pa.int32())])

    def told(columns):
        token, salt, sig, place, n, central = columns
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (sig[1:] != sig[:-1])
        token, salt, sig, place, n, central = (c[new] for c in columns)
        start = np.ones(len(token), bool)
        start[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        starts = np.flatnonzero(start)
        size = np.diff(np.append(starts, len(token)))
        group = np.repeat(np.arange(len(starts)), size)
        tops = np.flatnonzero(central == np.maximum.reduceat(central, starts)[group])
        top = tops[np.searchsorted(group[tops], np.arange(len(starts)))]
        held = np.flatnonzero((size[group] > 1) | (salt > 0))
        lead = top[group[held]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (token[held], salt[held], sig[held], n[held], place[held], sig[lead], n[lead], place[lead])], schema=schema)

    def run(batches):
        rest = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if rest is not None:
                columns = [np.concatenate(c) for c in zip(rest, columns)]
            token, salt = columns[:2]
            if not len(token):
                continue
            open_ = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            cut = int(open_[-1]) + 1 if len(open_) else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield told([c[:cut] for c in columns])
        if rest is not None and len(rest[0]):
            yield told(rest)

    dealt = post.repartition("token", "salt").sortWithinPartitions("token", "salt", "sig")
    return map_arrow(dealt.select("token", "salt", "sig", "place", "n", "central"), run, POSTINGS)


def meetings(post: DataFrame) -> DataFrame:
    """The first round's pairs: each shingle's most central class with its others."""
    return post.where("sig <> y_sig").select(F.col("sig").alias("x_sig"), F.col("n").alias("x_n"), F.col("place").alias("x_place"), "y_sig", "y_n", "y_place")


def candidates(met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of what met and passes the length and positional filters."""
    return met.where(f"{LENGTH_SQL} AND {POSITION_SQL}").select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct()


def overlap_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The suffix filter: pairs whose parities allow few enough differences."""
    sized = pairs.join(classes.select(F.col("sig").alias("a"), F.col("parity").alias("a_parity"), F.col("n").alias("a_n")), "a").join(classes.select(F.col("sig").alias("b"), F.col("parity").alias("b_parity"), F.col("n").alias("b_n")), "b")

    def run(batches):
        for batch in batches:
            a_n, b_n = (batch.column(i).to_numpy() for i in (3, 5))
            least = [int(differences(words_of(x.as_py()), words_of(y.as_py()))) for x, y in zip(batch.column(2), batch.column(4))]
            held = np.flatnonzero(few_enough(np.array(least, np.int64), a_n + b_n))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(held)) for i in (0, 1)], names=["a", "b"])

    return map_arrow(sized.select("a", "b", "a_parity", "a_n", "b_parity", "b_n"), run, "a long, b long")


def class_texts(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """sig and text (a Zstandard frame) of the wanted documents (doc_id, key, sig): one for each class."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return squeezed(rows, "text").join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("sig", "text")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, by the whole sets of both texts."""
    both = pairs.join(texts.select(F.col("sig").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("sig").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            held = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                names = [c.to_numpy(zero_copy_only=False) for c in (part.column(0), part.column(1))]
                every, at = np.unique(np.concatenate(names), return_index=True)
                frames = [part.column(2 + i // part.num_rows)[i % part.num_rows].as_py() for i in at.tolist()]
                sets = {}
                column = pa.array([unpack(f) for f in frames], pa.large_binary())
                for texts in B.chunks(column, most=CHUNK_ROWS):
                    hashes, bounds = shingle_sets(texts)
                    sets.update((s, hashes[a:b]) for s, a, b in zip(every[texts.first : texts.first + texts.n].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()))
                for i, (a, b) in enumerate(zip(*(n.tolist() for n in names)), lo):
                    x, y = sorted((sets[a], sets[b]), key=len)
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    if (NUMERATOR + DENOMINATOR) * int((y[at] == x).sum()) >= NUMERATOR * (len(x) + len(y)):
                        held.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(held, pa.int64())) for i in (0, 1)], names=["a", "b"])

    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long")


def linked(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, classes: DataFrame) -> DataFrame:
    """The links among pairs (written before), with the texts that they need and no others."""
    names = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    texts = stage(class_texts(docs, doc_id, text, classes.join(names, "sig").select("one.*", "sig")), "texts")
    out = stage(verified(pairs, texts), "linked")
    drop(texts)
    return out


NO_ID = -(1 << 63)


#: Classes of a shingle up to which its pairs are joined row by row, and the block sizes beyond.
SMALL, QUERY_BLOCK, ROW_BLOCK = 32, 1024, 65_536


def crossing(post: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """The second round's pairs: all that meet in an index prefix, are not in one component, and pass the filters.

    Per shingle, classes of its largest component need not meet each other. Shingles of a few classes are joined, which makes at most
    SMALL rows of one. Those of many are dealt in blocks of queries and blocks of rows; the filters run on arrays within a
    block, so that only pairs that pass become rows. Queries are the classes outside the largest component: those that have the
    shingle in their index prefix meet all (part 0), the others those of the largest component that have it there (part 1).
    """
    seen = post.select("token", "sig", "n", "place").withColumn("indexed", F.expr(INDEXED_SQL)).join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    mixed = seen.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.bool_or("indexed").alias("any")).where("least <> most AND any").select("token")
    seen = stage(seen.join(mixed, "token", "left_semi"), "crossing")
    sizes = seen.groupBy("token", "component").agg(F.count("*").alias("size"), F.count_if("indexed").alias("indexed"))
    size = [F.sum("size").alias("size"), F.sum("indexed").alias("indexed"), F.max(F.struct("size", "component", "indexed")).alias("major")]
    major = sizes.groupBy("token").agg(*size).selectExpr("token", "major.component AS major", "size", "indexed - major.indexed AS queries_0", "size - indexed - major.size + major.indexed AS queries_1", "major.indexed AS rows_1")
    told = seen.join(major, "token").withColumn("is_major", F.col("component") == F.col("major"))
    few = told.where(f"size <= {SMALL}")
    x = named(few.where("NOT is_major"), "x", "token", "sig", "n", "place", "component", "indexed")
    y = named(few, "y", "token", "sig", "n", "place", "component", "is_major", "indexed")
    met = x.join(y, F.expr(f"x_token = y_token AND x_component <> y_component AND (y_is_major OR x_sig < y_sig) AND {SMALLER_SQL} AND {LENGTH_SQL} AND {POSITION_SQL}"))
    small = overlap_filter(met.select(F.least("x_sig", "y_sig").alias("a"), F.greatest("x_sig", "y_sig").alias("b")).distinct(), classes)
    many = told.where(f"size > {SMALL} AND (queries_0 > 0 OR queries_1 > 0 AND rows_1 > 0)").join(classes.select("sig", "parity"), "sig")
    blocks = lambda n, block: F.ceil(F.col(n) / block).cast("int")
    part = lambda seed, n: F.pmod(F.xxhash64("sig", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["token", "part", "query_block", "row_block", "side", "sig", "n", "place", "component", "is_major", "indexed", "parity"]
    dealt = None
    for k, (asks, answers, n) in enumerate((("indexed AND NOT is_major", "queries_0 > 0", "size"), ("NOT indexed AND NOT is_major AND rows_1 > 0", "queries_1 > 0 AND indexed AND is_major", "rows_1"))):
        sized = many.withColumn("q", blocks(f"queries_{k}", QUERY_BLOCK)).withColumn("r", blocks(n, ROW_BLOCK)).withColumn("part", F.lit(k))
        queries = sized.where(asks).withColumn("query_block", part(1, "q")).withColumn("row_block", every("r")).withColumn("side", F.lit(0)).select(*columns)
        rows = sized.where(answers).withColumn("row_block", part(2, "r")).withColumn("query_block", every("q")).withColumn("side", F.lit(1)).select(*columns)
        both = queries.unionByName(rows)
        dealt = both if dealt is None else dealt.unionByName(both)
    dealt = dealt.repartition(*columns[:4]).sortWithinPartitions(*columns[:5])
    return small.unionByName(map_arrow(dealt, block_pairs, "a long, b long")).distinct()


def words_of(parity: bytes) -> np.ndarray:
    return np.frombuffer(parity, "<u8")


def few_enough(least: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes in all that differ in so many members at least can link."""
    return (NUMERATOR + DENOMINATOR) * least <= (DENOMINATOR - NUMERATOR) * total


class Queries:
    """A block's queries: columns, and parities in one array for each number of words, folded as rows ask for."""

    def __init__(self, columns: list[np.ndarray], parities: list[bytes]):
        self.columns, held = columns, {}
        for i, parity in enumerate(parities):
            held.setdefault(len(parity) // 8, []).append(i)
        self.sizes = {}
        self.where = np.zeros(len(parities), np.int64)
        self.size = np.array([len(p) // 8 for p in parities], np.int64)
        for size, rows in held.items():
            self.where[rows] = np.arange(len(rows))
            self.sizes[size, size] = np.stack([words_of(parities[i]) for i in rows])

    def least(self, at: np.ndarray, parity: np.ndarray) -> np.ndarray:
        """differences of the queries at and one row."""
        out = np.zeros(len(at), np.int64)
        for size in np.unique(self.size[at]).tolist():
            some, low = np.flatnonzero(self.size[at] == size), min(size, len(parity))
            if (size, low) not in self.sizes:
                self.sizes[size, low] = folded(self.sizes[size, size], low)
            out[some] = differences(self.sizes[size, low][self.where[at[some]]], folded(parity, low))
        return out


def block_pairs(batches):
    """Pairs of each block's queries (which come first) with its rows, in order of (token, part, query_block, row_block, side)."""
    current, held, queries = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            values = [part.column(i).to_numpy(zero_copy_only=False) for i in range(5, 11)]
            key = tuple(keys[:4, lo].tolist())
            if key != current:
                current, held, queries = key, [], None
            if keys[4, lo] == 0:
                held.append((values, part.column(11).to_pylist()))
                continue
            if queries is None and not held:
                continue
            if queries is None:
                queries = Queries([np.concatenate(c) for c in zip(*(v for v, _ in held))], [p for _, some in held for p in some])
                held = []
            sig, n, place, component, _, indexed = queries.columns
            sig2, n2, place2, component2, is_major, indexed2 = values
            for i, parity in enumerate(part.column(11)):
                small, large = np.minimum(n, n2[i]).astype(np.int64), np.maximum(n, n2[i]).astype(np.int64)
                after, before = np.minimum(n - place, n2[i] - place2[i]), np.minimum(place, place2[i])
                once = (sig < sig2[i]) if indexed2[i] and not is_major[i] else np.ones(len(sig), bool)  # such a row is a query, too
                ok = once & (component != component2[i]) & (DENOMINATOR * small >= NUMERATOR * large)
                ok &= np.where(n < n2[i], indexed, indexed2[i] & ((n > n2[i]) | indexed))
                ok &= (NUMERATOR + DENOMINATOR) * (after + before).astype(np.int64) >= NUMERATOR * (small + large)
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[few_enough(queries.least(at, words_of(parity.as_py())), (small + large)[at])]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[at], sig2[i])), pa.array(np.maximum(sig[at], sig2[i]))], names=["a", "b"])


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, sig, n) and components (sig, component) of the classes that link to others."""
    first = stage(first_pass(docs, doc_id, text), "sets")
    members = first.where("kind = 0").select("doc_id", "key", "sig", "n", "parity")
    cells = sketch(first)
    post = stage(shared_postings(postings(docs, text, cells)), "postings")
    classes = stage(members.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "key")).alias("one"), F.max("n").alias("n"), F.max("parity").alias("parity")), "classes")
    meet = candidates(meetings(post))
    # Salted groups of one shingle meet through their most central classes, of which there are as many as salts.
    tops = post.where("salt > 0 AND y_sig = sig").select("token", "sig", "n", "place")
    least = tops.groupBy("token").agg(F.min(F.struct("sig", "n", "place")).alias("y"))
    led = tops.join(least, "token").select("sig", "n", "place", F.col("y.sig").alias("y_sig"), F.col("y.n").alias("y_n"), F.col("y.place").alias("y_place"))
    pairs = stage(overlap_filter(meet.unionByName(candidates(meetings(led))).distinct(), classes), "pairs")
    links = linked(pairs, docs, doc_id, text, classes)
    labels = stage(components(links).withColumnRenamed("node", "sig"), "labels")
    more = stage(crossing(post, labels, classes).join(pairs, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(linked(more, docs, doc_id, text, classes))
    return members.drop("parity"), components(links).withColumnRenamed("node", "sig")


NO_ID_LAST = (1 << 63) - 1


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, key (hash of its text), n_shingles, component_id, and keeper: whether it is the one
    of its component to stay (the least doc_id, then key; documents without shingles always are)."""
    members, labels = join(docs, doc_id=doc_id, text=text)
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID_LAST)).alias("id"), "key")
    sized = members.where("sig IS NOT NULL").groupBy("sig").agg(F.min(place).alias("least")).join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    firsts = sized.groupBy("component").agg(F.min("least").alias("first"))
    by_class = sized.join(firsts, "component").select("sig", "first")
    return members.join(by_class, "sig", "left").select(
        "doc_id",
        "key",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).when(F.col("first.id") < NO_ID_LAST, F.col("first.id")).alias("component_id"),
        (F.col("sig").isNull() | (place == F.col("first"))).alias("keeper"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component, columns as they were. Documents without shingles stay; of rows that
    repeat the doc_id and text that stays, one stays."""
    found = stage(near_duplicates(docs, doc_id=doc_id, text=text), "found")
    names = [fresh(docs, n) for n in ("_id", "_key", "_gone_id", "_gone_key")]
    keyed = docs.withColumn(names[0], F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID_LAST))).withColumn(names[1], F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    gone = found.where("NOT keeper").select(F.coalesce("doc_id", F.lit(NO_ID_LAST)).alias(names[2]), F.col("key").alias(names[3])).distinct()
    left = keyed.join(gone, (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left_anti")
    if found.where("keeper AND n_shingles > 0").groupBy("doc_id", "key").count().where("count > 1").take(1):
        empty = F.length(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit("\t\n\x0b\x0c\r "))) == 0
        left = left.where(empty).unionByName(left.where(~empty).dropDuplicates(names[:2]))
    return left.select(*(f"`{c}`" for c in docs.columns))
