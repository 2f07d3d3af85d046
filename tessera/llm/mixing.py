"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key. Within each source the keys are cut into
ranges by their leading hex digits; the words of each range are summed, running
sums over the ranges, in two levels, give where each range starts, and a running
sum inside a range (a bounded number of rows) gives where each document starts. A
source's budget is then cut at an exact word: whole passes ("epochs") first, then
documents in key order until the rest of the budget is spent.

Rows of one source, id and size have one key; they are one row with a count until
their places are known, so an id that a third of all rows share makes no long range.

The ranges are an expression of the key and not of Spark's partitions, so that
results are the same on every run, after a lost executor, and for any number of
ranges. A source with a third of all rows is spread over all its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code-point order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)
#: Rows that a range of keys holds on average, at most.
RANGE_ROWS = 1_000
#: Equal rows (one source, id and size) that are made into rows again at once.
REPEATS = 10_000
#: Sources up to which their table goes to every task (a row has about 100 bytes).
BROADCAST_SOURCES = 50_000


def targets(sources: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), cap: int = 2) -> DataFrame:
    """Words that each source gives: (source, source_size) -> + (weight, target).

    All targets together are share[0]/share[1] of all sizes, shared by weight; a
    target stops at `cap` times its source's size, and the excess is shared among
    the others by weight until none is above. That is a water level: in the order
    of cap/weight, the first k sources are full and the level of the rest is what
    remains over their weight. Integers up to the last division.
    The table has one row for each source, and its windows are one task: sources are
    counted in thousands, at most some millions. Finer parts, such as a host name for
    each page, are to be grouped into sources first.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_source) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long")
    s = sources.select("source", "source_size", weight.alias("weight"))
    up_to = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    num, den = share
    s = s.select(
        "*",
        (num * F.sum("source_size").over(every) - den * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (den * (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("over"),
    )
    # full: its cap is below the level that would hold if all before it are full
    full = cap * F.col("source_size") * F.col("over") <= F.col("weight") * F.col("left")
    s = s.withColumn("full", full)
    first_open = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.struct("left", "over")))).over(first_open)
    level = level["col2"]
    return s.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("full") | level.isNull(), (cap * F.col("source_size")).cast("double"))
        .otherwise((F.col("weight") * level["left"]).cast("double") / level["over"])
        .alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights=WEIGHTS, share=(3, 2), cap: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken, mix_key.

    size: words of the text (null or empty: 0, then taken is 0). source: null is a
    source of its own. taken: words of this document in the mix, over all passes.
    Ties of the key fall to the smaller id, null last, then the smaller size; rows
    that repeat are rows of their own. An empty table gives an empty one. Extra
    columns are not read.
    """
    doc_id = F.col(id_col)
    key = _key(doc_id, seed)
    sized = common.cut(docs.select(doc_id.alias("doc_id"), F.col(source_col).alias("source"), common.n_words(F.col(text_col)).alias("size"), key.alias("mix_key")))
    return _mix_sized(sized, weights, share, cap, range_rows)


def _mix_sized(sized: DataFrame, weights, share, cap: int, range_rows: int, block: int = REPEATS) -> DataFrame:
    digits, rows = 0, sized.count()
    while rows > range_rows * 16**digits:
        digits += 1
    ranged = sized.withColumn("key_range", F.substring("mix_key", 1, digits))
    sums = common.cut(ranged.groupBy("source", "key_range").agg(F.sum("size").alias("range_size")))
    plan = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    # where each range starts: a running sum over coarse ranges, and one over the ranges of each
    fine = sums.withColumn("coarse", F.substring("key_range", 1, digits // 2))
    by_coarse = Window.partitionBy("source").orderBy("coarse")
    coarse = fine.groupBy("source", "coarse").agg(F.sum("range_size").alias("coarse_size"))
    coarse = coarse.select(F.col("source").alias("coarse_source"), F.col("coarse").alias("coarse_key"), (F.sum("coarse_size").over(by_coarse) - F.col("coarse_size")).alias("coarse_start"))
    by_range = Window.partitionBy("source", "coarse").orderBy("key_range")
    starts = fine.withColumn("inner_start", F.sum("range_size").over(by_range) - F.col("range_size"))
    starts = starts.join(coarse, F.col("source").eqNullSafe(F.col("coarse_source")) & (F.col("coarse") == F.col("coarse_key")))
    starts = starts.select(F.col("source").alias("range_source"), F.col("key_range").alias("range_key"), (F.col("coarse_start") + F.col("inner_start")).alias("range_start"))
    plan = plan.withColumnRenamed("source", "plan_source")
    starts = starts.join(plan, F.col("range_source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    equal = ranged.groupBy("source", "key_range", "mix_key", "doc_id", "size").agg(F.count("*").alias("rows"))
    inside = Window.partitionBy("source", "key_range").orderBy("mix_key", F.col("doc_id").asc_nulls_last(), "size")
    all_ = F.col("size") * F.col("rows")
    placed = equal.withColumn("first", F.sum(all_).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - all_)
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("key_range") == F.col("range_key")))
    # equal rows in blocks of bounded length, dealt over the tasks before they become rows
    starts_at = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(block).cast("long"))
    few = placed.filter(F.col("rows") <= block).withColumn("from", F.lit(0).cast("long"))
    many = placed.filter(F.col("rows") > block).withColumn("from", F.explode(starts_at)).repartition("mix_key", "from")
    last = F.least(F.col("from") + block, F.col("rows")) - 1
    placed = few.unionByName(many).withColumn("nth", F.explode(F.sequence("from", last))).withColumn("inside", F.col("first") + F.col("nth") * F.col("size"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("range_start") - F.col("inside")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), taken.cast("long").alias("taken"), "mix_key")


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """`docs` as the mix has them: every row as often as it is taken, whole documents only.

    A document that the budget cuts counts as taken if at least half of it is. What
    is decided of a source is a number of passes and the last place of its order that
    goes once more, so each row is decided where it lies: the documents are joined
    to one row for each source and not moved by key. Rows of one id and size are decided
    alike. A null or empty text is never taken.
    """
    place = lambda key, doc_id, size: F.struct(key.alias("k"), doc_id.isNull().alias("n"), doc_id.alias("d"), size.alias("s"))
    m = mix(docs, id_col, text_col, source_col, seed, **options)
    part = F.col("taken") - F.col("epochs") * F.col("size")
    again = F.when((2 * part >= F.col("size")) & (part > 0), place(F.col("mix_key"), F.col("doc_id"), F.col("size")))
    source, epochs, last, copies, copy = common.fresh(docs, "_source", "_epochs", "_last", "_copies", "_copy")
    plan = common.cut(m.groupBy(F.col("source").alias(source)).agg(F.max("epochs").alias(epochs), F.max(again).alias(last)))
    if plan.count() <= BROADCAST_SOURCES:  # checked; beyond it the join is left to Spark
        plan = F.broadcast(plan)
    own = place(_key(F.col(id_col), seed), F.col(id_col), common.n_words(F.col(text_col)))
    joined = docs.join(plan, F.col(source_col).eqNullSafe(F.col(source)))
    times = F.when(own["s"] > 0, F.col(epochs) + F.coalesce(own <= F.col(last), F.lit(False)).cast("long")).otherwise(0)
    taken = joined.withColumn(copies, times).filter(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS mix_key
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM per_source),
levels AS (
  SELECT *,
         (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS left_,
         (2 * (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS over_
  FROM weighed),
level AS (
  SELECT arg_min({'l': left_, 'o': over_}, source_size / weight) AS lv
  FROM levels WHERE NOT (2 * source_size * over_ <= weight * left_)),
planned AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size * over_ <= weight * left_ OR lv IS NULL THEN (2 * source_size)::DOUBLE
              ELSE (weight * lv.l)::DOUBLE / lv.o END AS target
  FROM levels LEFT JOIN level ON true),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(floor(p.target) / p.source_size)::BIGINT ELSE 0 END AS epochs,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.doc_id NULLS LAST, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - start, size)))::BIGINT AS taken
FROM placed
"""
