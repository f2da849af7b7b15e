"""The registry of models: labels, readiness, parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S


def labelled(models: DataFrame) -> DataFrame:
    """(name, label, translates) of the installed models."""
    return models.select("name").distinct().select("name", S.model_label(F.col("name")).alias("label"), F.col("name").rlike("|".join(K.TRANSLATOR_FAMILIES)).alias("translates"))


def integrity(spark: SparkSession, models: DataFrame, required: tuple = K.REQUIRED_MODELS) -> DataFrame:
    """(id, label, ready): whether some installed name contains the required one's untagged id.

    The required list is a constant of a few rows, so it is the broadcast side.
    """
    r = spark.createDataFrame(list(required), "id string, label string")
    installed = models.select("name").distinct()
    hit = installed.join(F.broadcast(r), F.contains(F.col("name"), F.element_at(F.split(F.col("id"), ":"), 1))).select("id").distinct()
    return r.join(hit.withColumn("ready", F.lit(True)), "id", "left").select("id", "label", F.coalesce("ready", F.lit(False)).alias("ready"))


def parameters(spark: SparkSession, models: DataFrame, specs: tuple = K.MODEL_PARAMS, untagged: bool = False) -> DataFrame:
    """(name, param, …) of installed models by exact id, or by label where ``untagged``."""
    s = F.broadcast(spark.createDataFrame(list(specs), "model string, param string, label string, type string, low double, high double, step double, value double"))
    m = models.select("name").distinct().withColumn("model", F.element_at(F.split(F.element_at(F.split("name", ":"), 1), "/"), -1) if untagged else F.col("name"))
    return m.join(s, "model").drop("model")
