"""Entities named in texts: longest multiword matches of labels, and labels that rejected texts keep asking for.

Words are runs of letters and digits, lower-cased; a label is its words with one space between them. A text's runs of as many words
as some label has become rows and meet the labels in an equi-join: broadcast while the labels are few (counted first), by shuffle
beyond. Of a text's matches, read from left to right, the longest at each place stays and what overlaps it goes; that scan streams
over the matches dealt by text and sorted, and holds one end of a match, however long the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Labels up to which their table is broadcast.
FEW_LABELS = 100_000
#: A name that is no label yet: two to five capitalised words in a row.
CANDIDATE = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,4}"


def words(text: Column) -> Column:
    """A text's words; of null, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def spelled(labels: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """phrase, size (words) and the least key of each label that has words."""
    found = labels.select(words(F.col(label)).alias("w"), F.col(key).alias("id")).where(F.size("w") > 0)
    return found.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("size")).agg(F.min("id").alias("id"))


def phrases(docs: DataFrame, sizes: list[int], doc_id: str, text: str) -> DataFrame:
    """doc_id, copy (a hash of the text), start, size and phrase: every run of the given numbers of words of every text."""
    w = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("copy"), words(F.col(text)).alias("w"))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct((i - 1).alias("start"), F.lit(n).alias("size"), F.array_join(F.slice("w", i, n), " ").alias("phrase"))))
    out = None
    for n in sizes:
        part = w.select("doc_id", "copy", F.explode(run(n)).alias("p")).select("doc_id", "copy", "p.*")
        out = part if out is None else out.unionByName(part)
    return out


def longest(matches: DataFrame) -> DataFrame:
    """Of matches (doc_id, copy, start, size, ...), those that a reader keeps who takes the longest at each place and goes on behind it."""
    place = [matches.columns.index(c) for c in ("doc_id", "copy", "start", "size")]

    def run(batches):
        text, end = None, 0
        for batch in batches:
            held = []
            for i, (doc, copy, start, size) in enumerate(zip(*(batch.column(p).to_pylist() for p in place))):
                if (doc, copy) != text:
                    text, end = (doc, copy), 0
                if start >= end:
                    end = start + size
                    held.append(i)
            yield batch.take(pa.array(held, pa.int64()))

    dealt = matches.repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "start", F.desc("size"))
    return dealt.mapInArrow(run, matches.schema)


def mentions(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label", key: str = "id", few: int = FEW_LABELS) -> DataFrame:
    """doc_id, start (words before), size, phrase and id of the labels that texts name. Of labels alike but for case and signs, the
    least key counts; rows that repeat both doc_id and text count once."""
    known = spelled(labels, label, key)
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    if not sizes:
        none = docs.limit(0).select(F.col(doc_id).alias("doc_id"), F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("phrase"))
        return none.withColumn("id", F.lit(None).cast(known.schema["id"].dataType))
    small = known.limit(few + 1).count() <= few
    met = phrases(docs, sizes, doc_id, text).join(F.broadcast(known) if small else known, ["phrase", "size"]).select("doc_id", "copy", "start", "size", "phrase", "id")
    return longest(met.distinct()).drop("copy")


def gate(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): whether a document has mentions."""
    named = found.select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(named, doc_id, "left_semi"), docs.join(named, doc_id, "left_anti")


def linked(found: DataFrame) -> DataFrame:
    """doc_id, id, times and first: which entities a document mentions, how often, and where first."""
    return found.groupBy("doc_id", "id").agg(F.count("*").alias("times"), F.min("start").alias("first"))


def shadows(rejected: DataFrame, labels: DataFrame, least: int, *, doc_id: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """label and docs: names (two to five capitalised words in a row, written small) in at least so many of the rejected documents that
    are no labels yet. A document counts once for a name, so that pairs are combined before they are shuffled by name."""
    names = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CANDIDATE), F.lit(0)), F.lower)
    asked = rejected.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(names)).alias("label")).distinct()
    often = asked.groupBy("label").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)
    known = labels.select(F.array_join(words(F.col(label)), " ").alias("label"))
    return often.join(known, "label", "left_anti")
