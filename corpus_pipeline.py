"""A corpus from raw documents to pieces: language, quality, near-duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns the columns of `documents`; the last returns each document's pieces. All
handle nulls, empty and very long texts, repeated rows, empty tables and extra
columns as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, language, mixing, near_copies, pieces, quality_rules


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model (fitted on these documents' labels) tells with KEEP_SCORE of their words at least."""
    pred, score = common.fresh(docs, "_lang", "_score")
    found = language.identify(docs, language.fit(docs), pred_col=pred, score_col=score)
    return found.filter((F.col(pred) != language.UNKNOWN) & (F.col(score) >= language.KEEP_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees."""
    forest = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    held = [c for c in docs.columns if c.lower() in {n.lower() for n in quality_rules.NEW}]
    clash = dict(zip(held, common.fresh(docs, *(f"_doc_{c}" for c in held)), strict=True))
    ruled = quality_rules.apply_rules(docs.withColumnsRenamed(clash), forest).filter("kept")
    return ruled.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash trees and MinHash bands propose, Jaccard of five words of 0.8 or more decides."""
    return near_copies.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the same document may come more than once."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of each document."""
    return pieces.encode(docs, pieces.PieceModel.load(pieces.default_model()))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The models and fingerprints cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
