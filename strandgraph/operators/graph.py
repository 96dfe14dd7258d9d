"""Graph views: decorated edges, thresholds, degrees, hop expansions, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import dealt, partitions, written


def decorated(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends; edges without one of them are dropped. Entities join by numeric id, which is
    unique over kinds."""
    ends = entities.select("id", "name")
    src = ends.select(F.col("id").alias("src_id"), F.col("name").alias("src_name"))
    dst = ends.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"))
    return edges.join(src, "src_id").join(dst, "dst_id").select("type", "src_id", "src_name", "src_kind", "dst_id", "dst_name", "dst_kind", F.coalesce("score", F.lit(0.0)).alias("score"))


def at_least(edges: DataFrame, min_score: float) -> DataFrame:
    """Edges scored min_score or more; a null score counts as 0. Where scores are maxima, give the source the bound, too: no filter goes
    below an aggregation by itself."""
    return edges.where(F.col("score") >= min_score) if min_score > 0 else edges.where(F.coalesce("score", F.lit(0.0)) >= min_score)


def degrees(edges: DataFrame) -> DataFrame:
    """id and degree: edges at either end, a self-loop once. Two equi-aggregations instead of an OR join."""
    ends = edges.select(F.col("src_id").alias("id")).unionByName(edges.where("dst_id <> src_id").select(F.col("dst_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def disease_subgraph(edges: DataFrame, disease_id: int) -> DataFrame:
    """Edges of a disease's view: disease to target; drug to the disease or those targets; those drugs to company.

    The second hop tests a fixed set, so that the result does not depend on the order of edges. Edges are a set. Frontiers are written, so that
    small ones are broadcast to the edges, below what these are grouped by; an edge is told by the last hop that has it, so the
    three together need no shuffle.
    """
    columns = ["type", "src_id", "dst_id", "src_kind", "dst_kind", "score"]
    first = edges.where((F.col("src_id") == disease_id) & (F.col("dst_kind") == "target"))
    own = edges.sparkSession.range(1).select(F.lit(disease_id).cast("long").alias("dst_id"))
    seen = written(first.select("dst_id").unionByName(own).distinct(), "front")
    drugs = edges.where("src_kind = 'drug'")
    second = drugs.join(seen, "dst_id", "left_semi")
    users = written(second.select("src_id").distinct(), "front")
    third = drugs.where("dst_kind = 'company'").join(users, "src_id", "left_semi")
    first = first.where("NOT (src_kind <=> 'drug')").select(*columns).distinct()
    return first.unionByName(second.where("NOT (dst_kind <=> 'company')").select(*columns)).unionByName(third.select(*columns))


def nodes_of(edges: DataFrame, *extra: int) -> DataFrame:
    """Ids at either end of edges, and extra ones."""
    out = edges.select(F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_id").alias("id")))
    for x in extra:
        out = out.unionByName(edges.sparkSession.range(1).select(F.lit(x).cast("long").alias("id")))
    return out.distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """id and hop: the least number of steps along edges, in either direction, up to a bounded number. A front is written, so that its size is
    known and a small one is broadcast to the edges, below what they are grouped by: only edges that a front meets are ever shuffled."""
    seen = front = starts.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = written(front, "front")
        ends = None
        for here, there in (("src_id", "dst_id"), ("dst_id", "src_id")):
            met = edges.select(here, there).join(front.select(F.col("id").alias(here)), here, "left_semi").select(F.col(there).alias("id"))
            ends = met if ends is None else ends.unionByName(met)
        front = ends.distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen


def descendants(tree: DataFrame, prefix: str, column: str = "tree_number") -> DataFrame:
    """Rows at or under a tree number; the bound is the dot, so C01 does not take C010."""
    return tree.where((F.col(column) == prefix) | F.col(column).startswith(f"{prefix}."))


def resolve(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """pairs (src_kind, src_cid, dst_kind, dst_cid, ...) with src_id and dst_id; pairs without an entity are dropped."""
    side = lambda p: entities.select(F.col("kind").alias(f"{p}_kind"), F.col("canonical_id").alias(f"{p}_cid"), F.col("id").alias(f"{p}_id"))
    return pairs.join(side("src"), ["src_kind", "src_cid"]).join(side("dst"), ["dst_kind", "dst_cid"])


def label_lookup(entities: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """label (lower-case name or alias) and the least id that has it: one row a label, so joins never fan out."""
    rows = entities.select(F.lower("name").alias("label"), "id")
    if aliases is not None:
        rows = rows.unionByName(aliases.select(F.lower("alias").alias("label"), "id"))
    return rows.where("label IS NOT NULL AND label <> ''").groupBy("label").agg(F.min("id").alias("id"))


def styled(edges: DataFrame) -> DataFrame:
    """Edges with line width and opacity."""
    from ..functions.scalar import edge_opacity, edge_width

    return edges.withColumns({"width": edge_width(F.col("score")), "opacity": edge_opacity(F.col("score"))})


def closure(tree: DataFrame, key: str = "ui", column: str = "tree_number") -> DataFrame:
    """key, ancestor (a tree number, its own included) and depth (steps up to it): each number's dotted beginnings."""
    parts = F.split(column, r"\.")
    n = F.size(parts)
    ups = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("ancestor"), (n - i).alias("depth")))
    return tree.where(F.col(column).isNotNull()).select(key, F.explode(ups).alias("up")).select(key, "up.ancestor", "up.depth")


def all_descendants(tree: DataFrame, key: str = "ui", column: str = "tree_number") -> DataFrame:
    """ancestor, key and depth for every descriptor at once: beginnings of tree numbers meet the numbers themselves in an equi-join, so a
    number makes as many rows as it has levels. Of several ways between two descriptors, the shortest counts."""
    named = tree.select(F.col(column).alias("ancestor"), F.col(key).alias("_ancestor")).distinct()
    met = closure(tree, key, column).join(named, "ancestor")
    return met.groupBy(F.col("_ancestor").alias("ancestor"), key).agg(F.min("depth").alias("depth"))


def all_subgraphs(edges: DataFrame) -> DataFrame:
    """The views of disease_subgraph for every disease at once: one row for each disease and edge. Edges are a set, written before, as they are
    read several times; ids are unique over kinds. Frontiers carry their disease and meet edges in equi-joins by node, over partitions that grow with
    the edges. The hops have no edge in common (they differ in the kinds of the ends), and frontiers are distinct, so no row is made twice,
    and the result, far larger than the edges, needs no shuffle."""
    columns = ["disease", "type", "src_id", "dst_id", "src_kind", "dst_kind", "score"]
    spark = edges.sparkSession
    n = partitions(spark, edges.count())
    first = edges.where("src_kind = 'disease' AND dst_kind = 'target'").withColumn("disease", F.col("src_id")).select(*columns).distinct()
    own = edges.where("src_kind = 'disease'").select(F.col("src_id").alias("disease"), F.col("src_id").alias("dst_id"))
    seen = first.select("disease", "dst_id").unionByName(own).distinct()
    drugs = edges.where("src_kind = 'drug'")
    met = dealt(drugs.where("dst_kind IN ('target', 'disease')"), n, "dst_id").join(dealt(seen, n, "dst_id"), "dst_id")
    second = written(met.select(*columns), "hop")
    users = dealt(second.select("disease", "src_id"), n, "src_id").distinct()
    third = dealt(drugs.where("dst_kind = 'company'"), n, "src_id").join(users, "src_id")
    return first.unionByName(second).unionByName(third.select(*columns))
