"""Sparse matrices as tables: patterns, offsets, transposes, fill, constraints, products.

A pattern is (row, col) without repeats; a matrix is (row, col, val); a block matrix
is (brow, bcol, blk) with row-major blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.prefix import prefix_sum
from tessera.session import cut

#: Rows of elements in a task on average, at most, where their nodes are packed and paired.
TASK_ROWS = 200_000


def tasks(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Tasks for the rows of `df` (read once to count them), at least one a core if they need more than one."""
    n = df.count() // task_rows + 1
    return n if n == 1 else max(n, df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """`df` by keys in `n` tasks; where one does, it is left to Spark.

    Spark puts the parts of a shuffle together by their bytes, before pairs are made of
    them, so that a task grows with the table; parts of a number given it leaves as they are.
    """
    return df.repartition(n, *keys) if n > 1 else df


def pairs(elem_nodes: DataFrame) -> DataFrame:
    """(row, col) with row < col for each element and each two of its nodes, dealt by row and col.

    The nodes of an element are packed once and paired inside the row: one shuffle on
    the element and one on the pair, no self-join.
    """
    n = tasks(elem_nodes)
    packed = dealt(elem_nodes.select("elem", "node"), n, "elem").groupBy("elem").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    made = packed.select(F.posexplode("nodes").alias("k", "row"), "nodes").select("row", F.explode(F.slice("nodes", F.col("k") + 2, F.size("nodes"))).alias("col"))
    return dealt(made, n, "row", "col")


def both_ways(half: DataFrame) -> DataFrame:
    """Rows (row, col, ...) and, off the diagonal, the same with row and col changed round."""
    rest = [c for c in half.columns if c not in ("row", "col")]
    there, back = F.struct("row", "col", *rest), F.struct(F.col("col").alias("row"), F.col("row").alias("col"), *rest)
    return half.select(F.inline(F.when(F.col("row").eqNullSafe(F.col("col")), F.array(there)).otherwise(F.array(there, back))))


def pattern(elem_nodes: DataFrame) -> DataFrame:
    """(row, col): pairs of nodes that share an element, the diagonal among them.

    A pair is made and shuffled one way only, and turned round when it is distinct.
    """
    diagonal = elem_nodes.select(F.col("node").alias("row"), F.col("node").alias("col")).dropna().distinct()
    return both_ways(pairs(elem_nodes).distinct()).union(diagonal)


def csr_offsets(pat: DataFrame) -> DataFrame:
    """(row, n, offset): entries of each row, and of all rows before it."""
    return prefix_sum(cut(pat.groupBy("row").agg(F.count("*").alias("n"))), "row", F.col("n"), "offset")


def indexed(pat: DataFrame) -> DataFrame:
    """(row, col, idx): the place of each entry in row-major order, from 0. `pat` is read three times."""
    inside = F.row_number().over(Window.partitionBy("row").orderBy("col")) - 1
    return pat.withColumn("_in", inside).join(csr_offsets(pat).select("row", "offset"), "row").select("row", "col", (F.col("offset") + F.col("_in")).cast("long").alias("idx"))


def transpose_map(pat: DataFrame) -> DataFrame:
    """(row, col, idx, tidx): the place in row-major and in column-major order.

    The entries go by row for the one number and carry it on by column for the other, so neither is joined back to them.
    """
    pat = cut(pat)  # instead of working it out for each number
    flipped = pat.select(F.col("col").alias("row"))
    starts = csr_offsets(flipped).select(F.col("row").alias("col"), "offset")
    inside = F.row_number().over(Window.partitionBy("col").orderBy("row")) - 1
    return indexed(pat).withColumn("_in", inside).join(starts, "col").select("row", "col", "idx", (F.col("offset") + F.col("_in")).cast("long").alias("tidx"))


def elem_index_map(elem_nodes: DataFrame, pat: DataFrame, perm: DataFrame | None = None) -> DataFrame:
    """(elem, n, m, idx): where the block of local nodes n, m goes; perm: (old, new). Pairs that `pat` lacks have no place.

    Each node of an element goes to its row with all nodes of the element, packed, and
    meets the entries of the row there; pairs are made and placed in that task and go nowhere.
    """
    nodes = elem_nodes.select("elem", "lnode", "node")
    n = tasks(nodes)
    if perm is not None:
        nodes = nodes.join(perm, F.col("node") == F.col("old")).select("elem", "lnode", F.col("new").alias("node"))
    pat = cut(pat.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")))  # read for the entries and for the rows' starts
    starts = cut(csr_offsets(pat).select("row", "offset"))
    nodes = nodes.select("elem", "lnode", F.col("node").cast("long").alias("node")).dropna(subset=["node"])
    packed = dealt(nodes, n, "elem").groupBy("elem").agg(F.collect_list(F.struct("node", "lnode")).alias("ns"))
    own = packed.select("elem", F.inline("ns").alias("row", "n"), F.col("ns.node").alias("cols"), F.col("ns.lnode").alias("ms"))
    none = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("elem", "n", "ms")}
    entries = pat.select(none["elem"].alias("elem"), "row", none["n"].alias("n"), F.array("col").alias("cols"), none["ms"].alias("ms"))
    met = dealt(own.union(entries), n, "row").select("row", "elem", "n", "ms", F.posexplode("cols").alias("k", "col"))
    met = met.select("row", "col", "elem", "n", F.col("ms")[F.col("k")].alias("m"), F.col("ms").isNull().alias("entry"))
    upto = Window.partitionBy("row").orderBy("col", F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("entry"), F.col("col")), ignorenulls=True).over(upto)
    met = met.withColumn("_last", last).withColumn("_in", F.count(F.when(F.col("entry"), 1)).over(upto) - 1).filter("not entry and _last = col")
    return met.join(starts, "row").select("elem", "n", "m", (F.col("offset") + F.col("_in")).cast("long").alias("idx"))


def bandwidth(pat: DataFrame) -> DataFrame:
    return pat.agg(F.coalesce(F.max(F.abs(F.col("row") - F.col("col"))), F.lit(0)).alias("bandwidth"))


def profile(pat: DataFrame) -> DataFrame:
    """Sum over rows of the distance from the diagonal to the first entry."""
    first = pat.groupBy("row").agg(F.min("col").alias("first"))
    return first.agg(F.sum(F.greatest(F.col("row") - F.col("first"), F.lit(0))).alias("profile"))


def n_values(pat: DataFrame, block: int) -> int:
    return pat.count() * block * block


def iluk(pat: DataFrame, k: int | None) -> DataFrame:
    """(row, col, lev): the pattern of ILU(k) with levels; k None: full fill.

    An entry (i, j) fills in at level h - 1 if a path of h edges joins i and j whose
    inner vertices are all below both. Paths grow by one edge a round: of each
    (i, j) only the least possible largest inner vertex is kept, and only paths that
    can still go on (end and inner vertices below i). A missing diagonal is put in.
    """
    pat = cut(pat.select("row", "col").distinct())
    edges = pat.filter("row <> col").select(F.col("row").alias("m"), F.col("col").alias("j"))
    ids = pat.select("row").union(pat.select("col")).distinct()
    found = cut(pat.union(ids.select("row", F.col("row").alias("col"))).distinct().withColumn("lev", F.lit(0)))
    front = pat.filter("col < row").select(F.col("row").alias("i"), F.col("col").alias("m"), F.lit(-1).cast("long").alias("inner"))
    reached = front
    hops = 1
    while k is None or hops <= k:
        step = front.join(edges, "m").filter("j <> i").select("i", "j", F.greatest("inner", "m").alias("inner"))
        step = step.groupBy("i", "j").agg(F.min("inner").alias("inner")).filter("inner < i")
        if k is None:  # only what is better than all shorter paths
            old = reached.select(F.col("i").alias("_i"), F.col("m").alias("_m"), F.col("inner").alias("_inner"))
            step = step.join(old, (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_m")), "left").filter("_inner is null or inner < _inner").select("i", "j", "inner")
        step = cut(step)
        if not step.take(1):
            break
        fill = step.filter("inner < j").select(F.col("i").alias("row"), F.col("j").alias("col"), F.lit(hops).alias("lev"))
        found = cut(found.union(fill).groupBy("row", "col").agg(F.min("lev").alias("lev")))
        front = step.filter("j < i").select("i", F.col("j").alias("m"), "inner")
        if k is None:
            reached = cut(reached.union(front).groupBy("i", "m").agg(F.min("inner").alias("inner")))
        hops += 1
    return found


def spmv(mat: DataFrame, vec: DataFrame) -> DataFrame:
    """(dof, val): the matrix times the vector (dof, val)."""
    x = vec.select(F.col("dof").alias("col"), F.col("val").alias("_x"))
    return mat.join(x, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("_x")).alias("val")).withColumnRenamed("row", "dof")


def transposed(mat: DataFrame) -> DataFrame:
    return mat.select(F.col("col").alias("row"), F.col("row").alias("col"), "val")


def merge_copy(target: DataFrame, source: DataFrame, n: int = 1) -> DataFrame:
    """Values of `source` in the pattern of `target`; new places are 0. Above 1, `n` is the number of tasks, as of `tasks`."""
    places, values = dealt(target.select("row", "col"), n, "row", "col"), dealt(source.select("row", "col", "val"), n, "row", "col")
    return places.join(values, ["row", "col"], "left").withColumn("val", F.coalesce("val", F.lit(0.0)))


def constrain(mat: DataFrame, bcs: DataFrame) -> DataFrame:
    """Rows and columns of constrained dofs zero, their diagonal 1."""
    hit = bcs.select("dof").distinct()
    out = mat.join(hit.select(F.col("dof").alias("_r")), F.col("row") == F.col("_r"), "left").join(hit.select(F.col("dof").alias("_c")), F.col("col") == F.col("_c"), "left")
    fixed = F.col("_r").isNotNull() | F.col("_c").isNotNull()
    return out.select("row", "col", F.when(fixed, F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)).otherwise(F.col("val")).alias("val"))


def block_to_coo(blocks: DataFrame, block: int) -> DataFrame:
    flat = blocks.select("brow", "bcol", F.posexplode("blk").alias("k", "val"))
    return flat.select((F.col("brow") * block + F.floor(F.col("k") / block)).alias("row"), (F.col("bcol") * block + F.col("k") % block).alias("col"), "val")


def coo_to_block(mat: DataFrame, block: int) -> DataFrame:
    """Row-major blocks; places without an entry are 0. A block's list is bounded."""
    at = (F.col("row") % block) * block + F.col("col") % block
    cells = mat.groupBy(F.floor(F.col("row") / block).alias("brow"), F.floor(F.col("col") / block).alias("bcol")).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.col("val")))).alias("_m"))
    return cells.select("brow", "bcol", F.transform(F.sequence(F.lit(0), F.lit(block * block - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("blk"))


def apply_perm(mat: DataFrame, perm: DataFrame) -> DataFrame:
    """P A P^T: rows and columns renumbered by perm (old, new)."""
    rows = perm.select(F.col("old").alias("row"), F.col("new").alias("_r"))
    cols = perm.select(F.col("old").alias("col"), F.col("new").alias("_c"))
    rest = [c for c in mat.columns if c not in ("row", "col")]
    return mat.join(rows, "row").join(cols, "col").select(F.col("_r").alias("row"), F.col("_c").alias("col"), *rest)


def union_pattern(*patterns: DataFrame, mirrored: bool = False) -> DataFrame:
    """Distinct union, e.g. of A and L; `mirrored`: of their transposes too.

    Then an entry and its mirror image are one row until they are distinct, so the
    transposes are neither worked out nor shuffled.
    """
    out = patterns[0].select("row", "col")
    for p in patterns[1:]:
        out = out.union(p.select("row", "col"))
    if not mirrored:
        return out.distinct()
    low, high = F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))
    turned = F.coalesce(F.col("row") > F.col("col"), F.col("row").isNull())  # a null comes last
    return both_ways(out.select(F.when(turned, high).otherwise(low).alias("e")).select("e.row", "e.col").distinct())


def without_diagonal(pat: DataFrame) -> DataFrame:
    return pat.filter("row <> col").distinct()
