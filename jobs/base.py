"""What the jobs share: a command line over a config file, tables that may not be there yet, written partitions."""

from __future__ import annotations

import argparse
import logging
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def existing(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at a path, without rows if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(rows: DataFrame, path: str, *columns: str) -> None:
    """Write rows in place of the partitions that they fall into; all other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def main(run: Callable[..., object], config: str, argv: list[str] | None = None) -> None:
    """Run a job from a config file, of which any value can be given on the command line; makes and stops the session."""
    first = argparse.ArgumentParser(add_help=False)
    first.add_argument("--config", default=config, help="TOML file of the job's arguments")
    path, rest = first.parse_known_args(argv)
    values = tomllib.loads(Path(path.config).read_text())
    parser = argparse.ArgumentParser(description=run.__doc__, parents=[first], formatter_class=argparse.RawDescriptionHelpFormatter)
    for name, value in values.items():
        parser.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    arguments = vars(parser.parse_args(rest))
    arguments.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **arguments)
    finally:
        spark.stop()
