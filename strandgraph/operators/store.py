"""Tables on Parquet: upserts, constraints, cascades and publication.

Parquet has no MERGE, DELETE or constraints, so each write is a plan over (present rows, batch) that yields the new table.
Publishing writes new versions beside the old ones and then commits them, any number of tables at once, by one numbered file of a log,
which is created only if there is none of that number: readers take the highest file that is whole, so a write that fails or
stops at any point leaves the tables as they were, and of two writers that began alike the second one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import json_merge
from ..schemas import FOREIGN_KEYS, KEYS, PARTITIONS, TABLES, Link
from .staging import written


class ConstraintError(ValueError):
    pass


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first by order; the top-1 filter is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(present: DataFrame, batch: DataFrame, keys: list[str], seq: str, first: dict[str, Column] | None = None) -> DataFrame:
    """Last write wins, column by column: the batch's last row of a key, by its sequence column, sets the columns that the batch has, to
    null too; others stay as they are. Rows of new keys have null there, or what `first` says for a column."""
    new = latest(batch, keys, [F.col(seq).desc()]).drop(seq)
    columns = [*present.columns, *(c for c in new.columns if c not in present.columns)]
    old = present.select(*(F.col(c).alias(f"_old_{c}") for c in present.columns), F.lit(True).alias("_old"))
    met = new.withColumn("_new", F.lit(True)).join(old, [new[k] == F.col(f"_old_{k}") for k in keys], "full")

    def value(c: str) -> Column:
        held = F.col(f"_old_{c}") if c in present.columns else F.lit(None)
        if c in new.columns:
            return F.when(F.col("_new"), F.col(c)).otherwise(held)
        return F.when(F.col("_old").isNull(), first[c]).otherwise(held) if first and c in first else held

    return met.select(*(value(c).alias(c) for c in columns))


def insert_if_absent(present: DataFrame, batch: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """First write wins: keys that are present stay as they are; of a batch's repeats the first by sequence enters."""
    new = latest(batch, keys, [F.col(seq).asc()]).drop(seq) if seq else batch.dropDuplicates(keys)
    return present.unionByName(new.join(present.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def merge_props(present: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """present with its JSON props merged with those of updates (one row a key), right wins; other rows stay as they are."""
    new = updates.select(*keys, F.col("props").alias("_props"))
    merged = F.to_json(json_merge(F.col("props"), F.col("_props")), {"ignoreNullFields": "false"})
    out = present.join(new, keys, "left").withColumn("props", F.when(F.col("_props").isNull(), F.col("props")).otherwise(merged))
    return out.select(*present.columns)


def orphans(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> DataFrame:
    """Child rows whose non-null keys have no parent."""
    named = parent.select(*(F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_keys))).distinct()
    filled = child.where(" AND ".join(f"`{c}` IS NOT NULL" for c in child_keys))
    on = [filled[c] == named[f"_p{i}"] for i, c in enumerate(child_keys)]
    return filled.join(named, on, "left_anti")


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ConstraintError(f"keys {keys} repeat")


def check_foreign(child: DataFrame, parent: DataFrame, child_keys: list[str], parent_keys: list[str]) -> None:
    if orphans(child, parent, child_keys, parent_keys).take(1):
        raise ConstraintError(f"{child_keys} has values without a parent")


def cascade_delete(child: DataFrame, gone: DataFrame, child_keys: list[str], gone_keys: list[str]) -> DataFrame:
    """Child rows without those of deleted parents."""
    named = gone.select(*(F.col(g).alias(c) for g, c in zip(gone_keys, child_keys))).distinct()
    return child.join(named, child_keys, "left_anti")


def parents_first(links: list[Link]) -> list[str]:
    """The tables of links, each after those that it refers to."""
    names = list(dict.fromkeys(n for link in links for n in (link.parent, link.child)))
    out: list[str] = []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and all(link.parent in out for link in links if link.child == n)]
        if not ready:
            raise ValueError("the foreign keys go round in a circle")
        out += ready
    return out


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame], links: list[Link] = FOREIGN_KEYS) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, removed) rows of each table that loses any when rows (gone) are deleted: what refers to them goes too, and what refers to
    that, through all levels. Tables are taken parents first, so each is joined once for each of its keys. The keys that go are written, so that their
    size is known, and few of them are broadcast to the children. A row that stays but refers to one that goes, by a key that does not
    cascade, is an error."""
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    held = [link for link in links if link.child in tables and link.parent in tables]
    order = [*(n for n in parents_first(links) if n in tables), *(n for n in gone if n not in {x for link in links for x in (link.parent, link.child)})]
    for name in order:
        rows, marks = tables[name], []
        lost = [(link.child_keys, out[link.parent][1], link.parent_keys) for link in held if link.child == name and link.cascade and link.parent in out]
        if name in gone:
            lost.append((KEYS.get(name, gone[name].columns), gone[name], KEYS.get(name, gone[name].columns)))
        if not lost:
            continue
        for i, (child_keys, parents, parent_keys) in enumerate(lost):
            named = parents.select(*(F.col(p).alias(f"_{i}_{j}") for j, p in enumerate(parent_keys)), F.lit(True).alias(f"_mark{i}")).distinct()
            named = written(named, "gone")
            rows = rows.join(named, [F.col(c) == F.col(f"_{i}_{j}") for j, c in enumerate(child_keys)], "left")
            marks.append(F.col(f"_mark{i}").isNotNull())
        any_ = marks[0]
        for m in marks[1:]:
            any_ = any_ | m
        columns = tables[name].columns
        out[name] = (rows.where(~any_).select(*columns), rows.where(any_).select(*columns))
    for link in held:
        if not link.cascade and link.parent in out:
            child = out[link.child][0] if link.child in out else tables[link.child]
            named = out[link.parent][1].select(*(F.col(p).alias(c) for p, c in zip(link.parent_keys, link.child_keys)))
            if child.join(named, list(link.child_keys), "left_semi").take(1):
                raise ConstraintError(f"{link.child} still refers to deleted rows of {link.parent}")
    return out


def evict(rows: DataFrame, now: Column) -> DataFrame:
    """The rows of a table with an expiry that have not expired."""
    return rows.where(F.col("expires_at") >= now)


#: What a write does to a whole table after its batch is in, given the time: a cache loses all that has expired, new or old.
AFTER_WRITE: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"lookup_cache": evict}


def entity_id(kind: Column, canonical_id: Column) -> Column:
    """A stable id from the natural key; writers check that it is unique."""
    return F.xxhash64(kind, canonical_id)


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    """Versioned Parquet tables under one root. now: the time of writes, the present by default."""

    def __init__(self, spark: SparkSession, root: str, now: Column | None = None):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _log(self) -> list[int]:
        """Numbers of the commits, whole or not, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.root}/_log") if n.endswith(".json") and n[0] != ".")

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/_log/{number:020d}.json"

    def _commit(self, number: int) -> dict[str, str] | None:
        """A commit's versions by table; None if it is not whole."""
        p, fs = self._fs(self._commit_path(number))
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        except (ValueError, KeyError, TypeError):
            return None
        finally:
            stream.close()

    def versions(self, at: int | None = None) -> dict[str, str]:
        """The version of each table, now or as of a commit's number."""
        numbers = [n for n in self._log() if at is None or n <= at]
        for number in reversed(numbers):
            found = self._commit(number)
            if found is not None:
                return found
        return {}

    def exists(self, name: str) -> bool:
        return name in self.versions()

    def missing(self) -> list[str]:
        """Declared tables that are not there."""
        held = self.versions()
        return [n for n in TABLES if n not in held]

    def create(self, names: list[str] | None = None) -> list[str]:
        """Create the declared tables (or those named) that are missing, empty, in the order of their declaration; the first
        error ends it, and what was created before stays. Returns the names created."""
        if unknown := set(names or ()) - set(TABLES):
            raise KeyError(f"undeclared tables {sorted(unknown)}")
        made = []
        for name in TABLES:
            if (names is None or name in names) and not self.exists(name):
                self.publish(name, self.spark.createDataFrame([], TABLES[name]))
                made.append(name)
        return made

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """A table, now or as of a commit's number; empty if it was never published."""
        version = self.versions(at).get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame) -> str:
        """Write a version with the declared columns, laid out and sorted for scans, and check its key. No reader sees it yet."""
        declared = self.spark.createDataFrame([], TABLES[name]).schema
        full = df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in declared))
        version = f"v-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        parts, keys = PARTITIONS.get(name, []), KEYS[name]
        out = full.sortWithinPartitions(*dict.fromkeys([*parts, *keys])).write
        (out.partitionBy(*parts) if parts else out).parquet(path)
        check_unique(self.spark.read.schema(declared).parquet(path), keys)
        return version

    def commit(self, versions: dict[str, str], after: int) -> int:
        """Make versions of some tables the present ones, all at once, as the commit after a number. Returns its own number."""
        tables = self.versions(after) | versions
        p, fs = self._fs(self._commit_path(after + 1))
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as error:
            raise Conflict(f"commit {after + 1} of {self.root} is taken") from error
        stream.write(bytearray(json.dumps({"tables": tables}).encode()))
        stream.close()
        return after + 1

    def last(self) -> int:
        return max(self._log(), default=0)

    def publish(self, name: str, df: DataFrame) -> int:
        return self.publish_all({name: df})

    def publish_all(self, frames: dict[str, DataFrame]) -> int:
        """Write new versions of tables and commit them together."""
        after = self.last()
        return self.commit({name: self.write(name, df) for name, df in frames.items()}, after)

    def _hooked(self, name: str, df: DataFrame) -> DataFrame:
        now = F.current_timestamp() if self.now is None else self.now
        return AFTER_WRITE[name](df, now) if name in AFTER_WRITE else df

    def upsert(self, name: str, batch: DataFrame, seq: str, first: dict[str, Column] | None = None) -> None:
        self.publish(name, self._hooked(name, upsert(self.read(name), batch, KEYS[name], seq, first)))

    def insert(self, name: str, batch: DataFrame, seq: str | None = None) -> None:
        self.publish(name, self._hooked(name, insert_if_absent(self.read(name), batch, KEYS[name], seq)))

    def delete(self, name: str, gone: DataFrame) -> list[str]:
        """Delete rows by their key, and what refers to them, through all levels, in one commit. Returns the tables that it touched."""
        after = self.last()
        tables = {n: self.read(n) for n in self.versions()}
        found = cascade(tables, {name: gone.select(*KEYS[name])})
        self.commit({n: self.write(n, kept) for n, (kept, _) in found.items()}, after)
        return list(found)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the versions that the last commits (so many whole ones) do not name. Returns what was deleted. Writers must be at rest:
        a version that is written but not committed yet is deleted, too."""
        whole = [c for c in (self._commit(n) for n in reversed(self._log())) if c is not None][: max(keep, 1)]
        named = {(name, version) for c in whole for name, version in c.items()}
        out = []
        for name in TABLES:
            for version in self._names(f"{self.root}/{name}"):
                if version.startswith("v-") and (name, version) not in named:
                    p, fs = self._fs(f"{self.root}/{name}/{version}")
                    fs.delete(p, True)
                    out.append(f"{name}/{version}")
        return sorted(out)
