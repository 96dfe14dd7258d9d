"""Loading steps by name, in order, over a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.graph import label_lookup, resolve
from ..operators.store import Store, entity_id
from ..schemas import license_allowlist
from ..sources import literals, payloads

ORDER = ["licenses", "mesh", "targets", "trials", "patents"]


def _entities(store: Store, df, source: str, now, seq=None) -> None:
    rows = df.withColumn("id", entity_id(F.col("kind"), F.col("canonical_id"))).withColumn("source", F.lit(source)).withColumn("updated_at", now)
    store.upsert("entity", rows.withColumn("_seq", seq if seq is not None else F.col("name")), "_seq", {"created_at": now})


def _edges(store: Store, df, source: str) -> None:
    rows = df.withColumns({"src_id": entity_id(F.col("src_kind"), F.col("src_cid")), "dst_id": entity_id(F.col("dst_kind"), F.col("dst_cid")), "source": F.lit(source)})
    store.insert("edge", rows)


def load_licenses(store: Store, paths: dict[str, str], now) -> None:
    store.insert("license_allowlist", license_allowlist(store.spark))


def load_mesh(store: Store, paths: dict[str, str], now) -> None:
    records = payloads.mesh_records(store.spark, paths["mesh"]).cache()
    for name, df in payloads.mesh_tables(records).items():
        store.insert(name, df)
    entity, alias = payloads.promoted_diseases(records, payloads.seed(store.spark, "ta_mapping", paths["ta_mapping"]))
    _entities(store, entity, "mesh", now)
    store.insert("alias", alias)
    records.unpersist()


def load_targets(store: Store, paths: dict[str, str], now) -> None:
    found = payloads.associations(store.spark, paths["associations"])
    _entities(store, found.select(F.lit("target").alias("kind"), "canonical_id", "name"), "opentargets", now)
    edge = found.select(F.lit("disease").alias("src_kind"), F.concat(F.lit("MESH:"), "mesh_id").alias("src_cid"), F.lit("target").alias("dst_kind"), F.col("canonical_id").alias("dst_cid"), F.lit("associated_with").alias("type"), "score", "props")
    diseases = store.read("entity").where("kind = 'disease'").select(F.col("canonical_id").alias("src_cid"))
    _edges(store, edge.join(diseases, "src_cid", "left_semi"), "opentargets")


def load_trials(store: Store, paths: dict[str, str], now) -> None:
    """Labels are those before the load."""
    diseases = store.read("entity").where("kind = 'disease'")
    aliases = store.read("alias").where("kind = 'disease'").join(diseases.select("kind", "canonical_id", "id"), ["kind", "canonical_id"])
    labels = label_lookup(diseases, aliases).join(diseases.select("id", "canonical_id"), "id").select("label", "canonical_id")
    found = payloads.studies(store.spark, paths["trials"]).where(payloads.in_window(F.col("last_update_posted"), paths.get("from"), paths.get("to")))
    made = payloads.trial_graph(found, labels)
    _entities(store, made["entity"], "ctgov", now)
    store.upsert("trial", made["trial"], "batch_seq")
    _edges(store, made["edge"], "ctgov")


def load_patents(store: Store, paths: dict[str, str], now) -> None:
    made = payloads.patents(store.spark, paths["patents"])
    store.insert("entity", made["entity"].withColumn("id", entity_id(F.col("kind"), F.col("canonical_id"))).withColumn("source", F.lit("patents")))
    _edges(store, made["edge"], "patents")


def load_demo(store: Store, paths: dict[str, str], now) -> None:
    """The literal graph: edges with an end that is no entity of the store are left out."""
    _entities(store, literals.entities(store.spark), "demo", now)
    known = store.read("entity").select("kind", "canonical_id", "id")
    _edges(store, resolve(literals.edges(store.spark), known).drop("src_id", "dst_id"), "demo")


STEPS: dict[str, Callable[[Store, dict[str, str], Column], None]] = {"licenses": load_licenses, "mesh": load_mesh, "targets": load_targets, "trials": load_trials, "patents": load_patents, "demo": load_demo}


def run(store: Store, paths: dict[str, str], steps: list[str] | None = None, now: Column | None = None) -> dict[str, int]:
    """Run the named steps in order (all by default) and return the rows of each table that is there. Unknown names are an error.
    now is the time of the rows written, the present by default."""
    wanted = steps or ORDER
    if unknown := set(wanted) - set(STEPS):
        raise ValueError(f"unknown steps {sorted(unknown)}; there are {ORDER}")
    for name in wanted:
        STEPS[name](store, paths, F.current_timestamp() if now is None else now)
    return {n: store.read(n).count() for n in ("entity", "edge", "trial", "mesh_descriptor", "alias") if store.exists(n)}
