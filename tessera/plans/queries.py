"""The operators over the driver's tables, each with SQL that gives the same rows.

The tables stand in for meshes: an order is an element, its suppliers are its nodes,
and quantities by (supplier, part) are a sparse matrix. Results are whole numbers, or
rounded once at the end, so that they do not hang on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.functions.prefix import dense_index
from tessera.operators import kdtree, near_fill, ordering, sparsity, topology, transfer, vectors
from tessera.plans import pipelines
from tessera.session import cut
from tessera.sources import bdf, generators, sinks
from tessera.streaming.scatter import scatter_add_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Of generated meshes and small files, with rows known beforehand: for tests, no queries over the tables.
FIXTURES: dict[str, Query] = {}
FIXTURE_SQL: dict[str, str] = {}


def fixture(sql: str | None = None):
    def add(f: Query) -> Query:
        FIXTURES[f.__name__] = f
        if sql:
            FIXTURE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, val): supplier by part, total quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).alias("val"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(elem, lnode, node): suppliers of an order's lines."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_linenumber").alias("lnode"), F.col("l_suppkey").alias("node"))


def pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparsity.pattern(elements(spark, sf_dir))


def perm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(old, new): suppliers ranked by (nation, key)."""
    s = table(spark, sf_dir, "supplier")
    key = s.select("s_suppkey", (F.col("s_nationkey") * 2**32 + F.col("s_suppkey")).alias("k"))
    return dense_index(key, "k", "new").select(F.col("s_suppkey").alias("old"), F.col("new").cast("long").alias("new"))


MATRIX = "SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity::BIGINT)::BIGINT AS v FROM lineitem GROUP BY 1, 2"
ELEMENTS = "SELECT DISTINCT l_orderkey AS elem, l_suppkey AS node FROM lineitem"
PATTERN = f"SELECT DISTINCT a.node AS r, b.node AS c FROM ({ELEMENTS}) a JOIN ({ELEMENTS}) b USING (elem)"
PERM = "SELECT s_suppkey AS old, row_number() OVER (ORDER BY s_nationkey, s_suppkey) - 1 AS new FROM supplier"
NODE_VALUES = "SELECT s_suppkey AS dof, round(s_acctbal * 100)::BIGINT AS val FROM supplier"


def node_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dof"), F.round(F.col("s_acctbal") * 100).cast("long").alias("val"))


@query(f"SELECT r AS dof, sum(v * p_size)::BIGINT AS val FROM ({MATRIX}) m JOIN part ON p_partkey = c GROUP BY 1")
def spmv(spark, d):
    return sparsity.spmv(matrix(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("dof"), F.col("p_size").alias("val")))


@query(f"SELECT c AS dof, sum(v * s_nationkey)::BIGINT AS val FROM ({MATRIX}) m JOIN supplier ON s_suppkey = r GROUP BY 1")
def spmv_transpose(spark, d):
    return sparsity.spmv(sparsity.transposed(matrix(spark, d)), table(spark, d, "supplier").select(F.col("s_suppkey").alias("dof"), F.col("s_nationkey").alias("val")))


@query("SELECT l_orderkey AS elem, count(*)::BIGINT AS n, sum(l_linenumber * s_nationkey)::BIGINT AS checksum FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def gather_elem(spark, d):
    values = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.lit(0).alias("dof"), F.col("s_nationkey").alias("val"))
    got = vectors.gather(elements(spark, d), values)
    return got.select("elem", F.size("vals").cast("long").alias("n"), F.aggregate("vals", F.lit(0).cast("long"), lambda s, x: s + x["lnode"] * x["val"]).alias("checksum"))


@query("SELECT l_suppkey AS node, sum(2 * l_quantity::BIGINT)::BIGINT AS val FROM lineitem GROUP BY 1")
def scatter_add(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_quantity").cast("long").alias("val"))
    return vectors.scatter_add(rows, ["node"], scale=2)


@query("SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity::BIGINT)::BIGINT AS val FROM lineitem GROUP BY 1, 2")
def matrix_scatter_add(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"), F.col("l_quantity").cast("long").alias("val"))
    return vectors.scatter_add(rows, ["r", "c"], scale=1)


@query("SELECT s_suppkey AS dof, round(s_acctbal * 100)::BIGINT AS val FROM supplier WHERE s_suppkey >= 10 AND s_suppkey < 60 AND (s_suppkey - 10) % 5 = 0")
def range_slice(spark, d):
    return vectors.range_slice(node_values(spark, d), "dof", 10, 60, 5)


@query(f"SELECT DISTINCT r AS \"row\", c AS col FROM ({PATTERN}) p")
def sparsity_pattern(spark, d):
    return pattern(spark, d)


@query(f'SELECT r AS "row", count(*)::BIGINT AS n, (sum(count(*)) OVER (ORDER BY r) - count(*))::BIGINT AS "offset" FROM ({PATTERN}) p GROUP BY r')
def csr_offsets(spark, d):
    return sparsity.csr_offsets(pattern(spark, d)).select("row", "n", F.col("offset").cast("long").alias("offset"))


@query(f'SELECT r AS "row", c AS col, row_number() OVER (ORDER BY r, c) - 1 AS idx, row_number() OVER (ORDER BY c, r) - 1 AS tidx FROM ({PATTERN}) p')
def csr_transpose_map(spark, d):
    return sparsity.transpose_map(pattern(spark, d))


@query(f"""WITH p AS (SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS idx FROM ({PATTERN}) x),
o AS (SELECT l_orderkey AS elem, l_linenumber AS ln, new AS node FROM lineitem JOIN ({PERM}) q ON old = l_suppkey WHERE true)
SELECT a.elem, a.ln AS n, b.ln AS m, idx FROM o a JOIN o b USING (elem)
JOIN (SELECT q1.new AS r, q2.new AS c, row_number() OVER (ORDER BY q1.new, q2.new) - 1 AS idx FROM p JOIN ({PERM}) q1 ON q1.old = p.r JOIN ({PERM}) q2 ON q2.old = p.c) z ON z.r = a.node AND z.c = b.node""")
def elem_ind_map(spark, d):
    q = cut(perm(spark, d))  # a small table is seen to be one, and the entries are not shuffled for it
    return sparsity.elem_index_map(elements(spark, d), sparsity.apply_perm(pattern(spark, d), q), q)


@query(f"SELECT max(abs(r - c))::BIGINT AS bandwidth FROM ({PATTERN}) p")
def bandwidth(spark, d):
    return sparsity.bandwidth(pattern(spark, d)).select(F.col("bandwidth").cast("long").alias("bandwidth"))


@query(f"SELECT sum(greatest(r - f, 0))::BIGINT AS profile FROM (SELECT r, min(c) AS f FROM ({PATTERN}) p GROUP BY r) q")
def profile(spark, d):
    return sparsity.profile(pattern(spark, d)).select(F.col("profile").cast("long").alias("profile"))


@query(f"""SELECT r AS "row", c AS col, CASE WHEN a.s_nationkey IN (1, 2, 3) OR r IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3)) OR c IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3))
THEN CASE WHEN r = c THEN 1 ELSE 0 END ELSE v END::BIGINT AS val FROM ({MATRIX}) m JOIN supplier a ON a.s_suppkey = r""")
def dirichlet_rows_cols(spark, d):
    held = table(spark, d, "supplier").filter(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("dof"))
    return sparsity.constrain(matrix(spark, d), held).select("row", "col", F.col("val").cast("long").alias("val"))


@query("SELECT s_suppkey AS dof, CASE WHEN s_nationkey IN (1, 2, 3) THEN 0 ELSE round(s_acctbal * 100)::BIGINT END::BIGINT AS val FROM supplier")
def vec_bcs(spark, d):
    held = table(spark, d, "supplier").filter(F.col("s_nationkey").isin(1, 2, 3)).select(F.col("s_suppkey").alias("dof"))
    return vectors.constrain(node_values(spark, d), held, 0).select("dof", F.col("val").cast("long").alias("val"))


@query(f"SELECT new AS dof, val FROM ({NODE_VALUES}) v JOIN ({PERM}) p ON old = dof")
def vec_permute(spark, d):
    return vectors.permute(node_values(spark, d), perm(spark, d))


@query(f"SELECT dof, sum(val)::BIGINT AS val FROM (SELECT * FROM ({NODE_VALUES}) a UNION ALL SELECT s_suppkey, s_nationkey FROM supplier) x GROUP BY dof")
def vec_add(spark, d):
    return vectors.add(node_values(spark, d), table(spark, d, "supplier").select(F.col("s_suppkey").alias("dof"), F.col("s_nationkey").alias("val")))


@query(f"SELECT sum(val * s_nationkey)::DOUBLE AS dot FROM ({NODE_VALUES}) v JOIN supplier ON s_suppkey = dof")
def vec_dot(spark, d):
    other = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dof"), F.col("s_nationkey").alias("val"))
    return spark.createDataFrame([(float(vectors.dot(node_values(spark, d), other)),)], "dot double")


@query(f"SELECT dof, val - 3 * s_nationkey AS val FROM ({NODE_VALUES}) v JOIN supplier ON s_suppkey = dof")
def vec_axpy(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dof"), F.col("s_nationkey").cast("double").alias("val"))
    return vectors.axpy(-3.0, x, node_values(spark, d)).select("dof", F.col("val").cast("long").alias("val"))


@query("SELECT round(coalesce(max(CASE WHEN abs(l_tax) > 0.01 THEN abs((l_discount - l_tax) / (l_tax + 1e-14)) END), 0), 9) AS rel_error FROM lineitem")
def rel_error_max(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("dof"), "l_discount", "l_tax")
    a, b = li.select("dof", F.col("l_discount").alias("val")), li.select("dof", F.col("l_tax").alias("val"))
    return vectors.rel_error(a, b, 0.01).select(F.round("rel_error", 9).alias("rel_error"))


@query(f"SELECT dof, val FROM ({NODE_VALUES}) v ORDER BY abs(val) DESC, dof LIMIT 1")
def argmax_abs(spark, d):
    return vectors.argmax_abs(node_values(spark, d))


@query(f'SELECT p.r AS "row", p.c AS col, coalesce(q.v, 0)::BIGINT AS val FROM ({PATTERN}) p LEFT JOIN (SELECT l_suppkey AS r, l_linenumber AS c, count(*) AS v FROM lineitem GROUP BY 1, 2) q USING (r, c)')
def merge_copy(spark, d):
    source = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.count("*").cast("double").alias("val"))
    return sparsity.merge_copy(pattern(spark, d), source, sparsity.tasks(elements(spark, d))).select("row", "col", F.col("val").cast("long").alias("val"))


@query(f'SELECT r // 3 AS brow, c // 3 AS bcol, count(*)::BIGINT AS n, sum(v * ((r % 3) * 3 + c % 3 + 1))::BIGINT AS checksum FROM ({MATRIX}) m GROUP BY 1, 2')
def bsr_blocks(spark, d):
    blocks = sparsity.coo_to_block(matrix(spark, d).withColumn("val", F.col("val").cast("double")), 3)
    back = sparsity.block_to_coo(blocks, 3).filter("val <> 0")
    key = [F.floor(F.col(c) / 3).cast("long") for c in ("row", "col")]
    weight = (F.col("row") % 3) * 3 + F.col("col") % 3 + 1
    return back.groupBy(key[0].alias("brow"), key[1].alias("bcol")).agg(F.count("*").alias("n"), F.sum(F.col("val").cast("long") * weight.cast("long")).alias("checksum"))


@query(f"""SELECT q1.new AS "row", q2.new AS col, n AS val FROM (SELECT a.node AS r, b.node AS c, count(*) * 100 + min(a.node) AS n FROM ({ELEMENTS}) a JOIN ({ELEMENTS}) b USING (elem) GROUP BY 1, 2) m
JOIN ({PERM}) q1 ON q1.old = r JOIN ({PERM}) q2 ON q2.old = c""")
def apply_perm(spark, d):
    """Suppliers by suppliers: the orders that they share, told apart by row, so that the matrix is not symmetric."""
    mesh = elements(spark, d)
    alone = sparsity.dealt(mesh.select("elem", "node"), sparsity.tasks(mesh), "elem").distinct()
    together = sparsity.both_ways(sparsity.pairs(mesh).groupBy("row", "col").agg(F.count("*").alias("n")))
    own = alone.groupBy(F.col("node").alias("row"), F.col("node").alias("col")).agg(F.count("*").alias("n"))
    shared = together.union(own).select("row", "col", (F.col("n") * 100 + F.col("row")).alias("val"))
    return sparsity.apply_perm(shared, cut(perm(spark, d)))


@query(f'SELECT r AS "row", c AS col FROM ({PATTERN}) p UNION SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT c, r FROM ({PATTERN}) p2')
def union_pattern(spark, d):
    p = pattern(spark, d)
    diagonal = table(spark, d, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_suppkey").alias("col"))
    return sparsity.union_pattern(p, diagonal, mirrored=True)


@query("SELECT l_suppkey AS node, list_sort(list(DISTINCT l_orderkey))::VARCHAR AS elems FROM lineitem GROUP BY 1")
def vert_elem_csr(spark, d):
    return topology.vertex_elements(elements(spark, d)).select("node", F.concat(F.lit("["), F.array_join(F.col("elems").cast("array<string>"), ", "), F.lit("]")).alias("elems"))


# a line that comes twice counts as one
LINES = "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2"
EDGES = "SELECT a.l_orderkey AS elem, a.l_linenumber AS part, least(a.l_suppkey, b.l_suppkey) AS lo, greatest(a.l_suppkey, b.l_suppkey) AS hi FROM L a JOIN L b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1".replace("FROM L a JOIN L b", f"FROM ({LINES}) a JOIN ({LINES}) b")


def _chains(spark, d) -> DataFrame:
    """(elem, part, verts): neighbouring lines of an order as edges."""
    li = elements(spark, d).groupBy("elem", "lnode").agg(F.min("node").alias("node"))
    after = li.select("elem", (F.col("lnode") - 1).alias("lnode"), F.col("node").alias("next"))
    return li.join(after, ["elem", "lnode"]).select("elem", F.col("lnode").alias("part"), F.array("node", "next").alias("verts"))


@query(f"SELECT DISTINCT lo, hi FROM ({EDGES}) e")
def unique_edges(spark, d):
    """Nothing is numbered for it: the sorted pairs themselves are distinct."""
    return _chains(spark, d).select(F.array_sort("verts").alias("key")).distinct().select(F.col("key")[0].alias("lo"), F.col("key")[1].alias("hi"))


@query(f"SELECT elem, part, dense_rank() OVER (ORDER BY f) - 1 AS edge FROM (SELECT elem, part, min(elem * 16 + part) OVER (PARTITION BY lo, hi) AS f FROM ({EDGES}) e) x")
def edge_ids_first_seen(spark, d):
    return topology._numbered(_chains(spark, d), "edge").select("elem", "part", "edge")


@query("""WITH f AS (SELECT l_orderkey AS elem, list_sort(list(l_suppkey)) AS k FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(*) = 3),
b AS (SELECT l_orderkey AS bface, list_sort(list(l_suppkey)) AS k FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 GROUP BY 1 HAVING count(*) = 3)
SELECT bface, (SELECT min(f.elem) FROM f WHERE f.k = b.k) AS elem FROM b""")
def face_match(spark, d):
    pack = lambda lo, hi: elements(spark, d).filter(F.col("lnode").between(lo, hi)).groupBy("elem").agg(F.collect_list("node").alias("verts")).filter(F.size("verts") == 3)
    faces = pack(1, 3).select("elem", F.lit(0).alias("part"), "verts", F.array_sort("verts").alias("key"), F.col("elem").alias("face"))
    tagged = pack(2, 4).select(F.lit("b").alias("tag"), F.col("elem").alias("bface"), "verts")
    return topology.boundary(faces, tagged).select("bface", "elem")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS idx FROM orders")
def renumber_dense(spark, d):
    return dense_index(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "idx").select("o_orderkey", "idx")


@query("SELECT c_custkey AS file_id, r.idx FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS idx FROM orders) r ON o_custkey = c_custkey")
def remap_ids(spark, d):
    ids = dense_index(table(spark, d, "orders").select("o_custkey").distinct(), "o_custkey", "idx")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("file_id")).join(ids, F.col("file_id") == F.col("o_custkey"), "left").select("file_id", "idx")


@query("SELECT c_custkey * 2 AS file_id FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def remap_miss(spark, d):
    """Ids that no node has: every second one of twice the customers' keys."""
    keys = dense_index(table(spark, d, "customer").select("c_custkey"), "c_custkey", "idx")
    asked = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("file_id"))
    return asked.join(keys, F.col("file_id") == F.col("c_custkey"), "left").filter("idx is null").select("file_id")


@query("SELECT node, dof FROM (SELECT o_orderkey AS node, unnest(string_split(o_orderkey::VARCHAR, ''))::INT - 1 AS dof FROM orders) x WHERE dof BETWEEN 0 AND 7")
def spc_explode(spark, d):
    cards = table(spark, d, "orders").select("o_orderkey", F.concat(F.rpad(F.lit("SPC"), 8, " "), F.lpad(F.lit("1"), 8, " "), F.lpad(F.col("o_orderkey").cast("string"), 8, " "), F.lpad(F.col("o_orderkey").cast("string"), 8, " ")).alias("head"))
    return bdf._spc_cards(cards.withColumn("line_no", F.lit(0))).select(F.col("file_node").alias("node"), "dof")


@query("SELECT l_orderkey, l_linenumber, round(round(l_extendedprice)::BIGINT / 1000.0, 6) AS val FROM lineitem")
def nastran_real(spark, d):
    text = F.concat(F.round("l_extendedprice").cast("long").cast("string"), F.lit("."), F.when(F.col("l_linenumber") % 2 == 0, "-3").otherwise("D-3"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(arrays.nastran_real(text), 6).alias("val"))


@query("SELECT c_custkey AS file_id, (c_custkey % 1000)::DOUBLE AS x, c_nationkey::DOUBLE AS y, 0.5::DOUBLE AS z FROM customer")
def fixed_width_cards(spark, d):
    c = table(spark, d, "customer")
    num = lambda v: F.lpad(F.concat(v.cast("long").cast("string"), F.lit(".")), 8, " ")
    head = F.concat(F.rpad(F.lit("GRID"), 8, " "), F.lpad(F.col("c_custkey").cast("string"), 8, " "), F.lpad(F.lit(""), 8, " "), num(F.col("c_custkey") % 1000), num(F.col("c_nationkey")), F.lpad(F.lit("5.-1"), 8, " "))
    cards = c.select(F.col("c_custkey").alias("line_no"), head.alias("head"), F.array().cast("array<string>").alias("more"))
    return bdf._node_cards(cards).select("file_id", "x", "y", "z")




GRAPH = "SELECT DISTINCT a.s_suppkey AS r, b.s_suppkey AS c FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey OR abs(a.s_suppkey - b.s_suppkey) = 7"


def small_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col): suppliers of one nation, and those seven keys apart, hang together."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by_nation = sparsity.pattern(s.select(F.col("s_nationkey").alias("elem"), F.col("s_suppkey").alias("node")))
    far = s.select(F.col("s_suppkey").alias("row"), (F.col("s_suppkey") + 7).alias("col")).join(s.select(F.col("s_suppkey").alias("col")), "col", "left_semi").select("row", "col")
    return by_nation.union(far).union(far.select("col", "row")).distinct()


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same graph without its pairs, which grow with the square of a nation: (row, col) of those seven keys apart, both ways, and the nations as (elem, node)."""
    s = cut(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("elem")).distinct())
    far = s.select(F.col("node").alias("row"), (F.col("node") + 7).alias("col")).join(s.select(F.col("node").alias("col")), "col", "left_semi").select("row", "col")
    return cut(far.union(far.select("col", "row")).distinct()), s.select("elem", "node").dropna()


def _least(far: DataFrame, nations: DataFrame) -> int:
    return far.select("row").union(nations.select("node")).agg(F.min("row")).first()[0]


@query(f"""WITH RECURSIVE g AS ({GRAPH}), walk AS (
SELECT min(r) AS node, 0 AS level FROM g UNION SELECT g.c, level + 1 FROM walk JOIN g ON g.r = walk.node WHERE level < 30)
SELECT node, min(level)::INT AS level FROM walk GROUP BY node""")
def rcm_levels(spark, d):
    far, nations = graph_parts(spark, d)
    return ordering.levels(far, _least(far, nations), nations)


@query(None)
def rcm_order(spark, d):
    far, nations = graph_parts(spark, d)
    return ordering.rcm(far, _least(far, nations), nations)


@query(f"""WITH g AS ({GRAPH}), p AS ({PERM}),
w AS (SELECT greatest(1, max(abs(a.new - b.new)) // 2) AS width FROM g JOIN p a ON a.old = g.r JOIN p b ON b.old = g.c)
SELECT old, new // width AS chunk FROM p, w""")
def qorder_chunks(spark, d):
    """The chunk of each node; places inside a chunk come from a seeded hash."""
    (far, nations), p = graph_parts(spark, d), cut(perm(spark, d))
    width = max(1, ordering.permuted_bandwidth(far, p, nations) // 2)
    return ordering.q_order(far, p, 2.0, groups=nations).select("old", F.floor(F.col("new") / width).alias("chunk"))


@query(f"SELECT new AS old, old AS new FROM ({PERM}) p")
def perm_invert(spark, d):
    return ordering.inverse(perm(spark, d))


@query(f"""WITH g AS (SELECT r, c FROM ({GRAPH}) q),
f1 AS (SELECT DISTINCT a.r AS r, b.c AS c FROM g a JOIN g b ON a.c = b.r WHERE a.r <> b.c AND a.c < least(a.r, b.c) AND a.r <> a.c AND b.r <> b.c),
f2 AS (SELECT DISTINCT a.r AS r, k.c AS c FROM g a JOIN g b ON a.c = b.r JOIN g k ON b.c = k.r
       WHERE a.r <> k.c AND greatest(a.c, b.c) < least(a.r, k.c) AND a.r <> a.c AND b.r <> b.c AND k.r <> k.c)
SELECT r AS "row", c AS col, min(lev)::INT AS lev FROM (SELECT r, c, 0 AS lev FROM g UNION ALL SELECT r, c, 1 FROM f1 UNION ALL SELECT r, c, 2 FROM f2) x GROUP BY 1, 2""")
def iluk_levels(spark, d):
    return near_fill.iluk(*graph_parts(spark, d), 2)


def _clouds(spark, d) -> tuple[DataFrame, DataFrame]:
    """(a points, s points): the first three components of embeddings, and the next three."""
    e = table(spark, d, "embeddings")
    at = lambda first: e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[first + i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return at(3), at(0)


POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
A_POINTS = "SELECT vec_id AS id, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings"
KNN = f"""SELECT a, s, d2, rn - 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, s) AS rn FROM (
SELECT a.id AS a, s.id AS s, pow(a.x - s.x, 2) + pow(a.y - s.y, 2) + pow(a.z - s.z, 2) AS d2 FROM ({A_POINTS}) a, ({POINTS}) s)) WHERE rn <= 8"""


@query(f"SELECT a, k::INT AS k, s, round(d2, 9) AS d2 FROM ({KNN}) q")
def knn_topk(spark, d):
    return transfer.knn(*_clouds(spark, d), 8).withColumn("d2", F.round("d2", 9))


# nine tenths of both clouds pulled into less than a hundredth of their box
def _squeezed(sql: str) -> str:
    return f"SELECT id, {', '.join(f'CASE WHEN id % 10 <> 0 THEN {c} * 0.2 ELSE {c} END AS {c}' for c in 'xyz')} FROM ({sql}) AS p"


def _clustered(spark, d) -> tuple[DataFrame, DataFrame]:
    squeeze = lambda p: p.select("id", *[F.when(F.col("id") % 10 != 0, F.col(c) * 0.2).otherwise(F.col(c)).alias(c) for c in "xyz"])
    a, s = _clouds(spark, d)
    return squeeze(a), squeeze(s)


@query(f"SELECT a, k::INT AS k, s, round(d2, 9) AS d2 FROM ({KNN.replace(A_POINTS, _squeezed(A_POINTS)).replace(POINTS, _squeezed(POINTS))}) q")
def knn_clustered(spark, d):
    return kdtree.knn(*_clustered(spark, d), 8).withColumn("d2", F.round("d2", 9))


@query("SELECT count(*) AS n, 0::BIGINT AS n_over FROM embeddings")
def kdtree_leaves(spark, d):
    """Points in leaves, and points in leaves over the bound: none."""
    a, s = _clustered(spark, d)
    leaves = kdtree.grown(a, s, 8, 64)[0].filter("is_s").groupBy("node").agg(F.count("*").alias("n"))
    return leaves.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("n") > 64, F.col("n"))), F.lit(0).cast("long")).alias("n_over"))


@query(f"SELECT a, s, round(exp(-20 * d2) / sum(exp(-20 * d2)) OVER (PARTITION BY a), 6) AS w FROM ({KNN}) q")
def gauss_weights(spark, d):
    a, s = _clouds(spark, d)
    return transfer.transfer_table(s, a, 8, 20.0).select("a", "s", F.round("w", 6).alias("w"))


@query(f"SELECT a, round(sum(w * x), 6) AS x, round(sum(w * y), 6) AS y, round(sum(w * z), 6) AS z FROM (SELECT a, s, exp(-20 * d2) / sum(exp(-20 * d2)) OVER (PARTITION BY a) AS w FROM ({KNN}) q) t JOIN ({POINTS}) p ON p.id = s GROUP BY a")
def weighted_centroid(spark, d):
    a, s = _clouds(spark, d)
    t = transfer.transfer_table(s, a, 8, 20.0).join(s.withColumnRenamed("id", "s"), "s")
    return t.groupBy("a").agg(*[F.round(F.sum(F.col("w") * F.col(c)), 6).alias(c) for c in "xyz"])


@query(f"""WITH t AS (SELECT a, w, x, y, z FROM (SELECT a, s, exp(-20 * d2) / sum(exp(-20 * d2)) OVER (PARTITION BY a) AS w FROM ({KNN}) q) t JOIN ({POINTS}) p ON p.id = s)
SELECT a, round(sum(w * x * x) - pow(sum(w * x), 2), 6) AS xx, round(sum(w * x * y) - sum(w * x) * sum(w * y), 6) AS xy, round(sum(w * y * y) - pow(sum(w * y), 2), 6) AS yy FROM t GROUP BY a""")
def weighted_cov(spark, d):
    a, s = _clouds(spark, d)
    t = transfer.transfer_table(s, a, 8, 20.0).join(s.withColumnRenamed("id", "s"), "s")
    m = lambda e: F.sum(F.col("w") * e)
    x, y = F.col("x"), F.col("y")
    return t.groupBy("a").agg(F.round(m(x * x) - F.pow(m(x), 2), 6).alias("xx"), F.round(m(x * y) - m(x) * m(y), 6).alias("xy"), F.round(m(y * y) - F.pow(m(y), 2), 6).alias("yy"))




@query("SELECT l_orderkey AS elem, list_sort(list(DISTINCT l_suppkey % 50 - 5) FILTER (l_suppkey % 50 - 5 >= 0))::VARCHAR AS ids FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_suppkey % 50 - 5 >= 0) > 0")
def unique_sort(spark, d):
    packed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("elem")).agg(F.collect_list(F.col("l_suppkey") % 50 - 5).alias("a"))
    ids = arrays.unique_sorted(F.col("a"))
    return packed.filter(F.size(ids) > 0).select("elem", F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("""SELECT l_orderkey AS elem, list_sort(list(DISTINCT v))::VARCHAR AS ids FROM (SELECT l_orderkey, l_suppkey % 20 AS v FROM lineitem UNION ALL SELECT l_orderkey, l_partkey % 20 FROM lineitem) x GROUP BY 1""")
def merge_sorted(spark, d):
    packed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("elem")).agg(F.sort_array(F.collect_list(F.col("l_suppkey") % 20)).alias("a"), F.sort_array(F.collect_list(F.col("l_partkey") % 20)).alias("b"))
    return packed.select("elem", F.concat(F.lit("["), F.array_join(arrays.merged(F.col("a"), F.col("b")).cast("array<string>"), ", "), F.lit("]")).alias("ids"))


@query("SELECT DISTINCT l_orderkey AS elem FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')")
def halo_elements(spark, d):
    owned = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("elem"))
    return topology.halo(elements(spark, d), owned, 1)  # an order without lines has no supplier, so nothing hangs on it


@query("SELECT event_type AS name, time_bucket(INTERVAL 10 MINUTES, ts) AS start, sum(round(value * 100)::BIGINT)::BIGINT AS val FROM events GROUP BY 1, 2")
def windowed_scatter_add(spark, d):
    rows = table(spark, d, "events").select("ts", F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("val"))
    return scatter_add_stream(rows, ["name"]).select("name", F.col("window.start").alias("start"), "val")


@query(None)
def shape_transfer(spark, d):
    """Linearised transfer of nation numbers as displacements between the clouds."""
    a, s = _clouds(spark, d)
    moves = s.select("id", *[F.round(F.col(c), 3).alias(c) for c in "xyz"])
    return transfer.linear_displacements(transfer.transfer_table(s, a, 8, 20.0), s, a, moves)


@query(None)
def transfer_loads(spark, d):
    a, s = _clouds(spark, d)
    return transfer.linear_loads(transfer.transfer_table(s, a, 8, 20.0), s, a, a)


@query(None)
def rigid_transfer(spark, d):
    a, s = _clouds(spark, d)
    return transfer.displacements(transfer.transfer_table(s, a, 8, 20.0), s, a, s.select("id", "x", "y", "z"))


@fixture(None)
def plate_static(spark, d):
    """An 8 x 8 plate under a sine load, solved directly."""
    m = pipelines.plate(spark, 8, 8)
    return m.solve(generators.plate_loads(m.nodes, 1.0, 2.0, 1.0, 8, 8)).withColumn("val", F.round("val", 12))


@fixture(None)
def plate_vtk(spark, d):
    m = pipelines.plate(spark, 8, 8)
    return sinks.vtk_lines(m.nodes, m.elem_nodes)


from tessera.plans import mesh_queries  # noqa: E402, F401  registers its queries
