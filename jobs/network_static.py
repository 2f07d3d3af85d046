"""Static analysis of a network of springs over the business tables.

Regions are supports. A nation hangs on its region, suppliers and customers hang on
their nation, and load comes from their lines (quantity) and orders (number). The job
assembles the springs' matrix, holds the supports, solves by the multifrontal solver,
checks the residual and that the supports carry the whole load, and writes the moves.

    python -m jobs.network_static NATION SUPPLIER CUSTOMER ORDERS LINEITEM OUT [--config FILE]

A spring's stiffness is its kind's in the config, times 1, 2 or 4 by the key of what
hangs on it. OUT is partitioned by nation (none for supports) and is replaced as a
whole, so a run may be repeated; the same tables give the same rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import default_config, log, main, new_folder, setting
from tessera.functions.prefix import dense_index
from tessera.operators import elimination, solvers, sparsity, vectors
from tessera.session import cut

NAME = "network_static"
#: Tables of files over this size are joined by shuffles: each that is broadcast goes through the driver, round after round.
BROADCAST = "64k"
OUT = "kind string, key long, load double, moved double, reaction double, nation long"


class NotBalancedError(RuntimeError):
    """The solution leaves forces at free nodes, or the supports do not carry the load."""


def springs(nation: DataFrame, supplier: DataFrame, customer: DataFrame, orders: DataFrame, lineitem: DataFrame, config: dict) -> DataFrame:
    """(kind, key, nation, on_kind, on_key, k, load): each hanging node, what it hangs on, the spring between and its load.

    Rows with a null key hang on nothing and are left out, as are loads of keys without a node. Repeated keys are one node.
    """
    lines = lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("load"))
    bought = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("load"))

    def hang(kind: str, rows: DataFrame, key: str, on: str, on_kind: str, loads: DataFrame | None) -> DataFrame:
        r = rows.select(F.col(key).cast("long").alias("key"), F.col(on).cast("long").alias("on_key")).dropna().groupBy("key").agg(F.min("on_key").alias("on_key"))
        r = r.join(loads, F.col("key") == F.col("id"), "left").drop("id") if loads is not None else r.withColumn("load", F.lit(0.0))
        of: Column = F.col("on_key") if on_kind == "nation" else F.col("key")
        k = config["stiffness"][kind] * F.pow(F.lit(2.0), F.pmod("key", F.lit(3)))
        return r.select(F.lit(kind).alias("kind"), "key", of.alias("nation"), F.lit(on_kind).alias("on_kind"), "on_key", k.alias("k"), F.coalesce("load", F.lit(0.0)).alias("load"))

    nations = hang("nation", nation, "n_nationkey", "n_regionkey", "region", None)
    below = hang("supplier", supplier, "s_suppkey", "s_nationkey", "nation", lines).unionByName(hang("customer", customer, "c_custkey", "c_nationkey", "nation", bought))
    return nations.unionByName(below.join(nations.select(F.col("key").alias("_n")), F.col("nation") == F.col("_n"), "left_semi"))


def run(spark: SparkSession, nation: str, supplier: str, customer: str, orders: str, lineitem: str, out: str, config: dict) -> DataFrame:
    """Solves and writes; returns OUT as read back: kind, key, load, moved, reaction, nation."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", BROADCAST):
        return _solved(spark, nation, supplier, customer, orders, lineitem, out, config)


def _solved(spark: SparkSession, nation: str, supplier: str, customer: str, orders: str, lineitem: str, out: str, config: dict) -> DataFrame:
    paths = (nation, supplier, customer, orders, lineitem)
    tables = [spark.read.parquet(p) for p in paths]
    hung = cut(springs(*tables, config))
    supports = hung.filter("on_kind = 'region'").select(F.col("on_kind").alias("kind"), F.col("on_key").alias("key")).distinct()
    nodes = hung.select("kind", "key", "nation", "load").unionByName(supports.select("kind", "key", F.lit(None).cast("long").alias("nation"), F.lit(0.0).alias("load")))
    nodes = cut(dense_index(nodes.withColumn("_id", F.struct("kind", "key")), "_id", "dof").drop("_id"))
    at = lambda kind, key, name: nodes.select(F.col("kind").alias(kind), F.col("key").alias(key), F.col("dof").alias(name))
    elems = hung.select("kind", "key", "on_kind", "on_key", "k").join(at("kind", "key", "a"), ["kind", "key"]).join(at("on_kind", "on_key", "b"), ["on_kind", "on_key"])
    cells = F.array(*[F.struct(F.col(r).alias("row"), F.col(c).alias("col"), (F.col("k") * s).alias("val")) for r, c, s in (("a", "a", 1.0), ("a", "b", -1.0), ("b", "a", -1.0), ("b", "b", 1.0))])
    whole = cut(vectors.scatter_add(elems.select(F.inline(cells)), ["row", "col"]))
    load, held = nodes.select("dof", F.col("load").alias("val")), cut(nodes.filter("kind = 'region'").select("dof"))
    mat = sparsity.constrain(whole, held).filter("val <> 0")
    rhs = cut(vectors.constrain(load, held))
    u = cut(elimination.multifrontal(mat, rhs))
    forces = cut(solvers.residual(whole, u, load))
    free = forces.join(held, "dof", "left_anti").agg(F.coalesce(F.max(F.abs("val")), F.lit(0.0)).alias("f")).first().f
    total, carried = (x.agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("s")).first().s for x in (load, forces.join(held, "dof", "left_semi")))
    bound = config["residual"] * max(1.0, total)
    if not (free <= bound and abs(total + carried) <= bound):
        raise NotBalancedError(f"forces of {free:.3g} at free nodes; the load is {total:.6g}, the supports carry {-carried:.6g}")
    rows = nodes.join(u.withColumnRenamed("val", "moved"), "dof").join(forces.withColumnRenamed("val", "force"), "dof")
    rows = rows.withColumn("reaction", F.when(F.col("kind") == "region", F.col("force")).otherwise(0.0))
    names = [c.split()[0] for c in OUT.split(", ")]
    rows.select(*names).repartition("nation").write.mode("overwrite").partitionBy("nation").parquet(out)
    found = spark.read.schema(OUT).parquet(out)
    log.info("%s: read %s; wrote %d nodes to %s; load %.6g, largest force at a free node %.3g", NAME, ", ".join(f"{t.count()} rows of {p}" for t, p in zip(tables, paths, strict=True)), found.count(), out, total, free)
    return found


def job2_network_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, NAME)
    for _ in range(2):  # the second run replaces the first one's output by the same rows
        found = run(spark, *[f"{sf_dir}/{t}.parquet" for t in ("nation", "supplier", "customer", "orders", "lineitem")], f"{out}/out", default_config(NAME))
    return found.select("kind", "key", "nation", *[(F.round(c, 5) + 0.0).alias(c) for c in ("load", "moved", "reaction")])


SQL = """
WITH loads AS (
  SELECT 'supplier' AS kind, s_suppkey::BIGINT AS key, s_nationkey::BIGINT AS nation, 4.0 * pow(2, s_suppkey % 3) AS k,
         coalesce((SELECT sum(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey), 0)::DOUBLE AS load FROM supplier
  UNION ALL
  SELECT 'customer', c_custkey::BIGINT, c_nationkey::BIGINT, 2.0 * pow(2, c_custkey % 3),
         (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::DOUBLE FROM customer),
nations AS (
  SELECT n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region, coalesce(sum(load), 0)::DOUBLE AS below,
         coalesce(sum(load), 0) / (8.0 * pow(2, n_nationkey % 3)) AS moved
  FROM nation LEFT JOIN loads ON n_nationkey = loads.nation GROUP BY n_nationkey, n_regionkey),
solved AS (
  SELECT kind, key, loads.nation, load, nations.moved + load / k AS moved, 0.0 AS reaction FROM loads JOIN nations USING (nation)
  UNION ALL SELECT 'nation', nation, nation, 0.0, moved, 0.0 FROM nations
  UNION ALL SELECT 'region', region, NULL, 0.0, 0.0, -sum(below) FROM nations GROUP BY region)
SELECT kind, key, nation, round(load::DOUBLE, 5) + 0.0 AS load, round(moved::DOUBLE, 5) + 0.0 AS moved, round(reaction::DOUBLE, 5) + 0.0 AS reaction FROM solved
"""

if __name__ == "__main__":
    main(NAME, __doc__.splitlines()[0], ["nation", "supplier", "customer", "orders", "lineitem", "out"], run, sys.argv[1:])
