"""Tables of a folder, job databases in JSON, and page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalars as S


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def job_database(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, name, status, progress, settings, results) of a JSON job database.

    The file is one object keyed by job id. A missing file is an empty database; unknown
    settings stay as text.
    """
    result = "array<struct<filename:string,regions:map<string,string>,extracted_text:string,translation:string,done:boolean>>"
    job = f"struct<id:string,name:string,status:string,progress:int,settings:map<string,string>,results:{result}>"
    out = "job_id string, name string, status string, progress int, settings map<string,string>, results " + result
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], out)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{job}>")).alias("job_id", "j")).select("job_id", "j.name", "j.status", "j.progress", "j.settings", "j.results")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, length, content) of a job's files; no databases and no crops."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = S.basename(F.col("path"))
    return f.select("path", name.alias("filename"), "length", "content").where(~name.endswith(".json") & ~name.contains("_crop_"))


def page_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, nChannels, mode, data) of the images that can be decoded."""
    i = spark.read.format("image").option("dropInvalid", True).load(folder)
    return i.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.mode", "image.data")


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty logical table."""
    return spark.createDataFrame([], getattr(schema, name.upper()))
