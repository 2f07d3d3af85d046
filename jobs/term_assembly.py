"""Incremental assembly of a sparse matrix from texts, as they arrive.

A document is an element, its words are the nodes that it contributes to, and its
source is the load case. The job keeps, for each case and word, what the assembler keeps for a node:
the elements that meet there (n_docs) and the sum of contributions (n_uses), which are
the column counts and column sums of the document-by-word matrix.

    python -m jobs.term_assembly DOCUMENTS OUT CHECKPOINT [--config FILE]

DOCUMENTS is a Parquet table that may grow by files; a file stream takes those that its
checkpoint has not seen, all that are there, and stops. Each batch becomes partial sums
in OUT/partials/case=/part=/batch=, and the (case, part) that it touches are summed
anew into OUT/terms/case=/part=. Both are overwritten by partition, so a batch that runs
again after a failure writes the same rows to the same places. A run without new files
writes nothing.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import default_config, log, main, new_folder, written

NAME = "term_assembly"
TERMS = "word string, n_docs long, n_uses long, case string, part int"
PARTIALS = "word string, n_docs long, n_uses long, case string, part int, batch long"
KEYS = ["case", "part", "word"]


def contributions(docs: DataFrame, config: dict) -> DataFrame:
    """(case, word, n_docs, n_uses): one row for each use of a word, and one for each word of a document.

    A null text has no words, a null case is a case of its own; rows that repeat are documents of their own.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(config["text"]), F.lit("")), F.lit(config["word"]), 0)
    each = docs.select(F.col(config["case"]).cast("string").alias("case"), words.alias("words"))
    rows = each.select("case", F.size("words").alias("n"), F.posexplode(F.concat("words", F.array_distinct("words"))).alias("k", "word"))
    use = F.col("k") < F.col("n")  # the words of the document follow its uses
    return rows.select("case", "word", F.when(use, 0).otherwise(1).cast("long").alias("n_docs"), F.when(use, 1).otherwise(0).cast("long").alias("n_uses"))


def _summed(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_uses").alias("n_uses"))


def partial_sums(docs: DataFrame, config: dict) -> DataFrame:
    """(case, word, n_docs, n_uses, part): the part of a word is worked out once for its sum, not for each use."""
    return _summed(contributions(docs, config), ["case", "word"]).withColumn("part", F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(config["parts"])).cast("int"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes what is new in `documents`; returns the whole of OUT/terms: word, n_docs, n_uses, case, part."""
    partials, terms = f"{out}/partials", f"{out}/terms"
    written(spark, partials, PARTIALS, ["case", "part", "batch"])
    written(spark, terms, TERMS, ["case", "part"])

    def take(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        new = partial_sums(batch, config).withColumn("batch", F.lit(batch_id).cast("long"))
        _replace(new, PARTIALS, ["case", "part", "batch"], partials)
        every = own.read.schema(PARTIALS).parquet(partials)
        touched = every.filter(F.col("batch") == batch_id).select(F.col("case").alias("_case"), F.col("part").alias("_part")).distinct()
        again = every.join(F.broadcast(touched) if config["parts"] <= 4096 else touched, F.col("case").eqNullSafe(F.col("_case")) & (F.col("part") == F.col("_part")), "left_semi")
        _replace(_summed(again), TERMS, ["case", "part"], terms)

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).parquet(as_glob(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    found = spark.read.schema(TERMS).parquet(terms)
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_uses"), F.lit(0)).alias("uses")).first()
    log.info("%s: read %d new documents of %s in %d batches; %s now has %d words with %d uses", NAME, sum(p["numInputRows"] for p in progress), documents, len(progress), terms, size.n, size.uses)
    return found


def as_glob(path: str) -> str:
    """`path` as a pattern that matches nothing else: a file stream takes a table of one file only by a pattern."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def _replace(rows: DataFrame, schema: str, partitions: list[str], path: str) -> None:
    """Writes over the partitions that `rows` has, and no other, a file each; `parts` bounds what one holds of a large case."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows.select(*names).repartition("case", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def job1_term_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, NAME)
    for _ in range(2):  # the second run finds nothing new
        found = run(spark, f"{sf_dir}/documents.parquet", f"{out}/out", f"{out}/checkpoint", default_config(NAME))
    return found.select("case", "word", "n_docs", "n_uses")


SQL = r"""
WITH w AS (SELECT source AS "case", regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
SELECT "case", word, sum(d)::BIGINT AS n_docs, sum(u)::BIGINT AS n_uses
FROM (SELECT "case", unnest(list_distinct(ws)) AS word, 1 AS d, 0 AS u FROM w UNION ALL SELECT "case", unnest(ws), 0, 1 FROM w) x
GROUP BY "case", word
"""

if __name__ == "__main__":
    main(NAME, __doc__.splitlines()[0], ["documents", "out", "checkpoint"], run, sys.argv[1:])
