"""Jobs as immutable snapshots: listing, status, settings, files, deletes, imports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .numbering import name_block, number_block, positions

KEY = ["job_id", "file_index"]


class NotFound(LookupError):
    """A job, file or region that does not exist."""


def list_jobs(jobs: DataFrame) -> DataFrame:
    """(id, status, progress, name), newest id first."""
    j = jobs.select("job_id", "status", "progress", "name").distinct()
    return j.select(F.col("job_id").alias("id"), "status", "progress", S.display_name(F.col("name"), F.col("job_id")).alias("name")).orderBy(F.desc("id"))


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """The rows of one job (at most one distinct); an empty frame if there is none."""
    return jobs.where(F.col("job_id") == job_id).distinct()


def require_job(jobs: DataFrame, job_id: str) -> DataFrame:
    x = get_job(jobs, job_id)
    if x.isEmpty():
        raise NotFound(job_id)
    return x


def pending_files(results: DataFrame) -> DataFrame:
    """Files that are not done yet: the work of a run or a rerun."""
    f = results.groupBy(*KEY).agg(F.min("filename").alias("filename"), F.max(F.coalesce("done", F.lit(False))).alias("done"))
    return f.where(~F.col("done")).drop("done")


def derive_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, n_files, n_done, n_failed, status) from the results themselves.

    ``failed`` if every file ended in an error, ``completed`` if every file has text or
    is done, ``queued`` otherwise.
    """
    f = results.groupBy(*KEY).agg(
        F.max(F.coalesce("done", F.lit(False)) | (F.length(F.coalesce("extracted_text", F.lit(""))) > 0)).alias("ready"),
        F.max(F.coalesce("extracted_text", F.lit("")).rlike(r"^(?:## Extracted by [^\n]+\n\n)?\[(?:Ollama Error|Error processing)")).alias("failed"),
    )
    n = f.groupBy("job_id").agg(F.count("*").alias("n_files"), F.count_if("ready").alias("n_done"), F.count_if("failed").alias("n_failed"))
    j = jobs.select("job_id").distinct().join(n, "job_id", "left").na.fill(0, ["n_files", "n_done", "n_failed"])
    status = F.when((F.col("n_files") > 0) & (F.col("n_failed") == F.col("n_files")), "failed").when(F.col("n_done") == F.col("n_files"), "completed").otherwise("queued")
    return j.withColumn("status", status)


def merge_settings(settings: DataFrame, patches: DataFrame) -> DataFrame:
    """(job_id, key, value): patches over settings, the latest ``ts`` of each key wins."""
    every = settings.select("job_id", "key", "value", F.lit(None).cast("timestamp").alias("ts")).unionByName(patches.select("job_id", "key", "value", "ts"))
    return every.groupBy("job_id", "key").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def rename(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Jobs with new names; a null or blank new name becomes the job's id."""
    n = names.groupBy("job_id").agg(F.max("name").alias("new_name"), F.lit(True).alias("hit"))
    new = F.when(F.length(F.trim(F.coalesce("new_name", F.lit("")))) > 0, F.col("new_name")).otherwise(F.col("job_id"))
    return jobs.distinct().join(n, "job_id", "left").withColumn("name", F.when(F.col("hit"), new).otherwise(F.col("name"))).drop("new_name", "hit")


def delete_jobs(df: DataFrame, doomed: DataFrame) -> DataFrame:
    """Any table keyed by ``job_id`` without the doomed jobs."""
    return df.join(doomed.select("job_id").distinct(), "job_id", "left_anti")


def add_files(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results with empty rows for new (job_id, filename) files, numbered after the last.

    Numbers continue per job by file name; names may repeat.
    """
    last = results.groupBy("job_id").agg((F.max("file_index") + 1).alias("start"))
    new = positions(files, "job_id", ["filename"], name_block("filename")).withColumn("at", F.col("pos") - 1).join(last, "job_id", "left").select(
        "job_id", (F.coalesce("start", F.lit(0)) + F.col("at")).cast("int").alias("file_index"), "filename",
        F.create_map().cast("map<string,string>").alias("regions"), F.lit("").alias("extracted_text"), F.lit("").alias("translation"), F.lit(False).alias("done"),
    )
    return results.unionByName(new)


def remove_files(files: DataFrame, doomed: DataFrame) -> DataFrame:
    """(job_id, file_index, old_index, filename): without the doomed files, numbered anew."""
    kept = files.join(doomed.select(*KEY).distinct(), KEY, "left_anti")
    kept = positions(kept, "job_id", ["file_index"], number_block("file_index"))
    return kept.select("job_id", (F.col("pos") - 1).cast("int").alias("file_index"), F.col("file_index").alias("old_index"), "filename")


def import_ids(incoming: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, new_id): an id in use gets the first free suffix _1, _2, …"""
    used = jobs.select("job_id").distinct()
    base = F.regexp_extract("job_id", r"^(.*)_(\d+)$", 1)
    taken = used.select(base.alias("orig"), F.regexp_extract("job_id", r"^(.*)_(\d+)$", 2).try_cast("int").alias("n")).where("orig <> '' AND n > 0")
    runs = taken.groupBy("orig").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    free = F.coalesce(F.element_at(F.filter(F.sequence(F.lit(1), F.size("ns") + 1), lambda i: ~F.array_contains("ns", i)), 1), F.lit(1))
    x = incoming.select("job_id").distinct()
    x = x.join(used.withColumn("clash", F.lit(True)), "job_id", "left").join(runs.withColumnRenamed("orig", "job_id"), "job_id", "left")
    return x.select("job_id", F.when(F.col("clash"), F.concat("job_id", F.lit("_"), F.when(F.col("ns").isNull(), F.lit(1)).otherwise(free).cast("string"))).otherwise(F.col("job_id")).alias("new_id"))


def unique_names(files: DataFrame) -> DataFrame:
    """(job_id, file_index, filename, staged): each file in turn takes its name, or the first free of _1, _2, …

    Free means taken by no earlier file, whether as its own name or as a new one. Names
    can only meet if they agree without their numbered ends. Among those with no numbered
    name of their own the places alone decide; the others are gone through in turn.
    """
    stem, ext = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("filename", r"(\.[^.]*)$", 1)
    f = files.select("job_id", "file_index", "filename").withColumn("family", F.concat(F.regexp_replace(stem, r"(_\d+)+$", ""), ext)).withColumn("numbered", stem.rlike(r"_\d+$"))
    copies = f.groupBy("job_id", "family").agg((F.max("numbered") & (F.count("*") > F.count_distinct("filename"))).alias("meet"))
    f = f.join(copies, ["job_id", "family"])
    plain = f.where("NOT meet").withColumn("name_key", F.to_json(F.struct("job_id", "filename")))
    n = positions(plain, "name_key", ["file_index"], number_block("file_index")).withColumn("n", F.col("pos") - 1)
    alone = n.select("job_id", "file_index", "filename", F.when(F.col("n") == 0, F.col("filename")).otherwise(F.concat(stem, F.lit("_"), F.col("n").cast("string"), ext)).alias("staged"))

    def in_turn(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        following: dict[str, int] = {}
        out = []
        pdf = pdf.sort_values("file_index")
        for name in pdf["filename"]:
            new, k = name, following.get(name, 1)
            base, dot, end = name.rpartition(".")
            while new in taken:
                new = f"{base}_{k}.{end}" if dot else f"{name}_{k}"
                k += 1
            following[name] = k
            taken.add(new)
            out.append(new)
        return pdf.assign(staged=out)[["job_id", "file_index", "filename", "staged"]]

    met = f.where("meet").groupBy("job_id", "family").applyInPandas(in_turn, "job_id string, file_index int, filename string, staged string")
    return alone.unionByName(met)


def log_tail(logs: DataFrame, n: int = 50) -> DataFrame:
    """The last n distinct events as (time, level, msg), oldest first; top-n, no full sort."""
    level = F.upper(F.coalesce("level", F.lit("INFO")))
    t = logs.select("ts", level.alias("level"), "msg").distinct().orderBy(F.desc("ts"), F.desc("msg"), F.desc("level")).limit(n)
    return t.select(S.clock(F.col("ts")).alias("time"), "level", "msg", "ts").orderBy("ts", "msg", "level")


def queue_order(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, file_index, filename, slot): the order in which queued files come up in a job."""
    q = jobs.where("status = 'queued'").select("job_id").distinct()
    f = pending_files(results).join(q, "job_id", "left_semi")
    return positions(f, "job_id", ["file_index"], number_block("file_index"), out="slot")
