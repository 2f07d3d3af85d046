"""What the jobs share: config, log, and the command line around a function that takes a session."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.session import checkpoint_folder, get_session

log = logging.getLogger("tessera.jobs")


def load_config(path: str | Path, **given: object) -> dict:
    """The JSON config, with what the command line gives over it."""
    return json.loads(Path(path).read_text()) | {k: v for k, v in given.items() if v is not None}


def default_config(name: str) -> dict:
    return load_config(Path(__file__).with_name("config") / f"{name}.json")


def written(spark: SparkSession, path: str, schema: str, partitions: list[str]) -> DataFrame:
    """The table at `path`, which exists from now on: nothing is changed where it did before."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*partitions).parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with a setting changed, which is as it was afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a name not used before, under spark.checkpoint.dir."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def main(name: str, about: str, paths: list[str], run: Callable, argv: list[str] | None = None) -> None:
    """Parses paths and --config, and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", default=str(Path(__file__).with_name("config") / f"{name}.json"))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session(name)
    try:
        run(spark, *[getattr(args, p) for p in paths], load_config(args.config))
    finally:
        spark.stop()
