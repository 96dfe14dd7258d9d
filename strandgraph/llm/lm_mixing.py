"""Language-model scores by online logistic context mixing, beside a smoothed word model.

Three passes over texts, each narrow; what they hand on grows with the texts:

1. training texts' words are counted (by 64-bit hash, combined before the shuffle, every word of every text) and their bytes after a byte and
   the class of the one before it, which make the code trees of `mixing`;
2. each task counts its training texts' decisions in tables of hashed contexts, and learns mixing weights online: it predicts every
   chunk from what it counted before, and steps down the cost's gradient; so every training text teaches the weights. Tables are handed over
   packed, in segments that are added up apart; weights are averaged by the decisions that taught them;
3. all texts are scored: the mixed model in place, and words by the counts of the most frequent ones (at most HEAD, broadcast);
   the others' words are joined with the table of counts, once a text, so that no frequent word is ever a join key.

The driver holds the tables as bytes, CELLS for each context, whatever the input: a documented size of the hashed model, not of the
counts. A held-out text is only ever scored.

Defined results: a null text is empty, its one token is the end; a null doc_id neither trains nor is held out; without training texts
the base is 0 (log10 of 1) and the model knows nothing; repeated rows train and are scored each; extra columns are kept or not
read; an empty table gives no rows. Equal hashes of two words would count them together (odds of n * n / 2 ** 65 for n words).
The model's score is of the lower-cased words with a space after each, and the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords as B
from . import mixing as M
from .common import drop, free_names, map_arrow, stage, tidy

FOLDS, HELD_OUT = 7, 2
#: Words whose counts are broadcast, at most: 4 MB.
HEAD = 1 << 18
#: Segments of a table, each added up in one task, and bytes of texts counted and scored at once.
SEGMENTS, CHUNK, SCORED = 64, 1 << 18, 1 << 16
#: Tasks whose counts of a segment are added up in one task.
FAN = 256
#: A byte after a class and a byte that is not one in 2 ** RARE is counted as never seen in the code trees.
RARE = 18
#: Upper bits of a word's hash that tell where to look for it in the head.
SLOT_BITS = 20
#: Words that a task counts before it combines them.
GATHER = 1 << 20

#: Bytes as streams have them: lower-cased, white space as spaces.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 0x20
PLAIN[0x09:0x0E] = M.SPACE


@dataclass
class WordModel:
    """counts (token, n): training words by hash. total and kinds with the end, which each of texts training texts has once."""

    counts: DataFrame
    total: int
    kinds: int
    texts: int
    #: The most frequent words' hashes, in order, and their counts; every word counted cut or more times is among them.
    head: np.ndarray
    often: np.ndarray
    cut: int

    @property
    def share(self) -> int:
        return self.total + self.kinds + 1


@dataclass
class LanguageModel:
    words: WordModel
    bits: M.Model


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def counted(texts: DataFrame) -> DataFrame:
    """kind 0: a word's hash and count; kind 1: a byte after a class and a byte, and their count; kind 2: the number of texts."""

    def run(batches):
        held, n, triples, rows = [], 0, np.zeros(M.CLASSES << 16, np.int64), 0

        def told(kind, keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64) if kind else keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            rows += batch.num_rows
            for part in B.chunks(batch.column(0), CHUNK):
                found = B.words(part, B.SPACES)
                np.add.at(triples, M.triples_of(PLAIN.take(part.data)), 1)
                held.append(B.word_hashes(part, found))
                n += len(held[-1])
                if n > GATHER:
                    yield told(0, *np.unique(np.concatenate(held), return_counts=True))
                    held, n = [], 0
        if n:
            yield told(0, *np.unique(np.concatenate(held), return_counts=True))
        if rows:
            yield told(1, np.flatnonzero(triples), triples[triples > 0])
            yield told(2, np.zeros(1), np.full(1, rows))

    return map_arrow(texts, run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (in order) and counts of the words counted at least cut times, and cut: the least such that they are at most `most`.
    Cuts are powers of the fourth root of two, so that counts make some 200 classes whatever the input."""
    size = F.floor(4 * F.log2("n")).cast("int")
    level, held = 0, 0
    for r in counts.groupBy(size.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += r["words"]
        if held > most:
            level = r["level"] + 1
            break
    rows = counts.where(size >= level).select("token", "n").collect()
    keys, often = np.array([r["token"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], often[order], level


def word_model(texts: DataFrame, most: int = HEAD) -> tuple[WordModel, np.ndarray]:
    """The word model of texts (one column), and the counts of their stream's bytes by 65536 * class + 256 * before + byte (but for repeated white space, and
    for those so rare that a tree need not know them)."""
    found = stage(counted(texts), "words")
    counts = found.where("kind = 0").select(F.col("key").alias("token"), "n")
    sums = {r["kind"]: r for r in found.groupBy("kind").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).collect()}
    kinds, total = (sums[0]["kinds"], sums[0]["total"]) if 0 in sums else (0, 0)
    rows = sums[2]["total"] if 2 in sums else 0
    triples = np.zeros((M.CLASSES, 256, 256), np.int64)
    if 1 in sums:
        for r in found.where((F.col("kind") == 1) & (F.col("n") >= sums[1]["total"] >> RARE)).select("key", "n").collect():  # at most 2 ** RARE rows
            triples.reshape(-1)[r["key"]] = r["n"]
    # a text's end comes after a space; after which class is not counted
    spaces = triples[:, M.SPACE].sum(axis=1)
    triples[:, M.SPACE, M.END] += rows * (spaces + 1) // int(spaces.sum() + M.CLASSES)
    return WordModel(counts, total + rows, kinds + (rows > 0), rows, *head_of(counts, most)), triples.reshape(-1)


def predictors(texts: DataFrame, tree: M.Tree) -> DataFrame:
    """table, segment, part (the task), cells: a task's counts, packed; and one row of table -1 whose values are what its weights learned."""
    shared = texts.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        from pyspark import TaskContext

        tree, counts, mixer, learned, rows = shared.value, M.Counts(), M.Mixer.new(), 0, 0
        for batch in batches:
            rows += batch.num_rows
            for part in B.chunks(batch.column(0), CHUNK):
                for data, bounds in M.pieces(part, B.words(part, B.SPACES)):
                    found = M.met(data, bounds, tree)
                    learned += counts.teach(mixer, data, bounds, tree, found)
                    counts.add(data, bounds, tree, found)
        if rows:
            pack, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId()
            for i in range(M.TABLES):
                cells = [pack(c.astype(np.uint64).tobytes()) for c in counts.cells[i].reshape(SEGMENTS, -1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(SEGMENTS, i, np.int32)), pa.array(np.arange(SEGMENTS, dtype=np.int32)), pa.array(np.full(SEGMENTS, part, np.int32)), pa.array(cells, pa.binary()), pa.nulls(SEGMENTS, pa.list_(pa.float64()))], names=names)
            values = np.concatenate(([learned], learned * mixer.weights.reshape(-1), mixer.seen.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([None], pa.binary()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=names)

    names = ["table", "segment", "part", "cells", "values"]
    return map_arrow(texts, run, "table int, segment int, part int, cells binary, values array<double>")


def added_up(found: DataFrame, last: bool) -> DataFrame:
    """table, segment, part, cells: the counts of FAN parts each, added up; the last time as a byte a cell."""

    def run(batches):
        unpack, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for *key, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                part = np.frombuffer(unpack(cells.as_py()), np.uint64)
                sums[tuple(key)] = sums[tuple(key)] + part if tuple(key) in sums else part
        pack = zstandard.ZstdCompressor(level=3).compress
        for key, cells in sums.items():
            out = M.packed(cells[0::2].astype(np.float64), cells[1::2].astype(np.float64)) if last else cells
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), pa.array([pack(out.tobytes())], pa.binary())], names=["table", "segment", "part", "cells"])

    dealt = found.select("table", "segment", F.floor(F.col("part") / FAN).cast("int").alias("part"), "cells").repartition("table", "segment", "part")
    return map_arrow(dealt, run, "table int, segment int, part int, cells binary")


def summed(found: DataFrame) -> DataFrame:
    """table, segment, cells: all tasks' counts added up, as a byte a cell, packed. FAN of them meet in a task; where there are more, their
    sums are written and added up in turn, so that no task ever takes more than FAN of one segment."""
    parts = found.where("table >= 0").select("table", "segment", "part", "cells")
    most = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while most >= FAN:
        parts, most = stage(added_up(parts, last=False), "sums"), most // FAN
    return added_up(parts, last=True)


def bit_model(texts: DataFrame, triples: np.ndarray) -> M.Model:
    tree = M.tree_of(triples)
    found = stage(predictors(texts, tree), "predictors")
    cells, unpack = np.full((M.TABLES, SEGMENTS, M.CELLS // SEGMENTS), M.LEVELS // 2, np.uint8), zstandard.ZstdDecompressor().decompress
    for r in summed(found).collect():  # CELLS bytes a table
        cells[r["table"], r["segment"]] = np.frombuffer(unpack(r["cells"]), np.uint8)
    values = found.where("table < 0").select(F.posexplode("values").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    told = {r["place"]: r["value"] for r in values.collect()}
    mixer, size = M.Mixer.new(), M.GATES * M.INPUTS
    if told.get(0):
        mixer.weights = np.round([told[1 + i] / told[0] for i in range(size)], 6).reshape(M.GATES, M.INPUTS)
        mixer.seen = np.round([told[1 + size + i] for i in range(mixer.seen.size)]).reshape(mixer.seen.shape)
    drop(found)
    tidy()
    return M.Model(tree, cells.reshape(M.TABLES, -1), mixer)


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", head: int = HEAD) -> LanguageModel:
    """Models of the texts whose fold is not HELD_OUT."""
    texts = docs.where(fold(F.col(doc_id)) != HELD_OUT).select(text)
    words, triples = word_model(texts, head)
    return LanguageModel(words, bit_model(texts, triples))


def slots_of(head: np.ndarray) -> np.ndarray:
    """By the upper bits of a hash, the place in head of the first that has them (that of the last, if none has)."""
    return np.minimum(np.searchsorted(head, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)), max(len(head) - 1, 0))


def found_in(head: np.ndarray, slots: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes' places in head (sorted), and whether they are there. Most are where their upper bits say; only those of head's few that share these with one before are
    searched for."""
    if not len(head):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    place = slots.take((hashes >> np.uint64(64 - SLOT_BITS)).view(np.int64))
    at = head.take(place)
    common = at == hashes
    after = np.flatnonzero(at < hashes)
    further = np.minimum(place[after] + 1, len(head) - 1)
    after = after[head[further] <= hashes[after]]
    place[after] = np.minimum(np.searchsorted(head, hashes[after]), len(head) - 1)
    common[after] = head[place[after]] == hashes[after]
    return place, common


def scored(docs: DataFrame, model: LanguageModel, text: str, keep: list[str]) -> DataFrame:
    """kind 0: a row's number, keep, and its scores (words: those of the head, and the end); kind 1: a rare word of a row, and how often."""
    words = model.words
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, words.head, np.log10((words.often + 1) / words.share)))
    end, end_known = math.log10((words.texts + 1) / words.share), words.texts > 0
    row, kind = free_names(keep, "row", "kind")
    given = docs.select(F.monotonically_increasing_id().alias(row), *(f"`{c}`" for c in keep), F.col(text).alias(free_names([*keep, row], "text")[0]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*(f"`{c}`" for c in keep)).schema]
    schema = ", ".join([f"`{kind}` int", f"`{row}` long", *kept, "n_tokens long", "n_known long", "base double", "bits double", "n_bytes long", "token long", "often long"])
    names = [kind, row, *keep, "n_tokens", "n_known", "base", "bits", "n_bytes", "token", "often"]

    def run(batches):
        bits, head, logs = shared.value
        bits, slots = replace(bits, cells=bits.cells.copy()), slots_of(head)  # a copy lies in large pages, where random places are read faster
        for batch in batches:
            for part in B.chunks(batch.column(1 + len(keep)), SCORED):
                here = batch.slice(part.first, part.n)
                found = B.words(part, B.SPACES)
                n = np.diff(found.rows)
                at = np.repeat(np.arange(part.n), n)
                hashes = B.word_hashes(part, found)
                place, common = found_in(head, slots, hashes)
                base = np.bincount(at[common], logs[place[common]], minlength=part.n) + end
                known = np.bincount(at[common], minlength=part.n) + end_known
                cost, size, state = np.zeros(part.n), np.zeros(part.n, np.int64), None
                for data, bounds in M.pieces(part, found):
                    more, state = bits.bits(data, bounds, state if len(bounds) == 2 else None)
                    cost += more
                    size += np.diff(bounds) - M.PAD
                none = lambda kind, n=part.n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.n, np.int32)), *(here.column(i) for i in range(1 + len(keep))), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(cost), pa.array(size), none(pa.int64()), none(pa.int64())], names=names)
                if not common.all():
                    rare, of = hashes[~common], at[~common]
                    order = np.lexsort((rare, of))
                    rare, of = rare[order], of[order]
                    last = np.flatnonzero(np.concatenate(((rare[1:] != rare[:-1]) | (of[1:] != of[:-1]), [True])))
                    none = lambda kind, n=len(last): pa.nulls(n, kind)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(last), np.int32)), here.column(0).take(pa.array(of[last])), *(none(here.column(1 + i).type) for i in range(len(keep))), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), none(pa.int64()), pa.array(rare[last].view(np.int64)), pa.array(np.diff(last, prepend=-1))], names=names)

    return map_arrow(given, run, schema)


def score(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (all columns by default) and n_tokens, n_known, base_score, score (log10), n_bytes, bits_per_byte; of the names given
    here, one that keep has gets underscores before it."""
    keep = docs.columns if keep is None else keep
    inner = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)), F.col(f"`{text}`").alias("text"))
    found, words = stage(scored(given, model, "text", inner), "scored"), model.words
    rare = words.counts.where(F.floor(4 * F.log2("n")) < words.cut)
    met = found.where("kind = 1").select("row", "token", "often").join(rare, "token", "left")
    each = F.col("often") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(words.share)))
    more = met.groupBy("row").agg(F.sum(each).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("often")).otherwise(0)).alias("plus"))
    out = found.where("kind = 0").drop("token", "often", "kind").join(more, "row", "left")
    names = free_names(keep, "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte")
    values = [F.col("n_tokens"), F.col("n_known") + F.coalesce("plus", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0)), F.col("bits") * -math.log10(2), F.col("n_bytes"), F.col("bits") / F.col("n_bytes")]
    return out.select(*(F.col(i).alias(c) for c, i in zip(keep, inner)), *(v.alias(n) for v, n in zip(values, names)))


def digest(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score")
