"""Getting the package to the Python workers of a cluster."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context.

    Workers that already have it on their path are not harmed: it is the same code.
    """
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        path = os.path.join(tempfile.mkdtemp(prefix="paperloom-"), "paperloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("paperloom", os.path.relpath(full, here)))
        sc.addPyFile(path)
    sc._paperloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that ships the package before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; on one machine, one beside the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "paperloom-checkpoints")
    return where


def written_once(df: DataFrame) -> DataFrame:
    """The rows of a frame, evaluated once and kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
