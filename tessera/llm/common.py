"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_folder, cut  # noqa: F401  (used by the operators as common.cut)

#: Characters that part words for the contracts on documents: space and \t..\r.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column) -> Column:
    """True on rows whose labels no model may see: crc32(doc_id as text) mod 3 is 1. A null id: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in the text; null: 0. JVM only."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own, like `names`, that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def thinned(df: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """About `n` rows of `df` (all, if there are fewer) to fit a model on, by a hash of `key`.

    The same rows on every run, in a filter: nothing is sorted or gathered for it.
    `total`: the rows of `df`, or more, if the caller knows; counted otherwise.
    """
    total = df.count() if total is None else total
    if total <= n:
        return df
    parts = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(parts)) < int(parts * n / total))


def sample_rows(df: DataFrame, key: str, n: int, total: int | None = None) -> list:
    """About `n` rows of `df` on the driver, never over 2 `n`; `n` is a documented parameter of each operator."""
    return first_rows(thinned(df, key, n, total), 2 * n).collect()


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """`df`, or the same `n` rows of it on every run if it has more (as where an id repeats)."""
    return df.orderBy(F.xxhash64(*df.columns)).limit(n)


def wider(schema: T.StructType, **kinds: str) -> T.StructType:
    """`schema` with fields more, of the named types."""
    return T.StructType([*schema.fields, *(T.StructField(k, T.StructType.fromDDL(f'{k} {v}')[k].dataType) for k, v in kinds.items())])
