"""The batch pipeline: resolve, explode, infer, assemble; whole runs and reruns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import jobs as J
from ..operators import regions as R
from ..operators.images import cut_pages
from ..operators.inference import ModelClient, infer
from ..session import written_once

KEY = ["job_id", "file_index"]


def work_list(results: DataFrame, file_polygons: DataFrame, jobs: DataFrame, force: bool = False) -> DataFrame:
    """Regions (and whole files) of the pending files, with ``reused`` where stored text stands.

    Boxes are in the unit square: a page's size is only known once it is decoded, and
    whether a box has some area doesn't depend on it.
    """
    todo = results if force else results.join(J.pending_files(results).select(*KEY), KEY, "left_semi")
    every = R.explode_regions(R.resolve_polygons(todo, file_polygons, jobs))
    whole = every.where("origin = 'whole'").withColumn("box", F.lit(None).cast("struct<left:double,top:double,right:double,bottom:double>"))
    part = R.boxes(every.where("origin <> 'whole'"), F.lit(1.0), F.lit(1.0))
    w = R.needs_model(whole.unionByName(part), results)
    settings = jobs.groupBy("job_id").agg(F.max("model_version").alias("model"), F.max("prompt").alias("prompt"))
    return w.join(settings, "job_id", "left").withColumns({"model": F.coalesce("model", F.lit("unknown")), "prompt": F.coalesce("prompt", F.lit(""))})


def options_of(settings: DataFrame) -> DataFrame:
    """(job_id, options): the model options among a job's (job_id, key, value) settings, as text."""
    s = settings.where(F.col("key").isin(*K.DEFAULT_OPTIONS) & F.col("value").isNotNull())
    return s.groupBy("job_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("options"))


def cuts(work: DataFrame, pages: DataFrame, options: DataFrame | None = None) -> DataFrame:
    """What the model is to see of the work that isn't reused: crops, whole files, or errors.

    Each page meets its regions once, by file; its bytes are decoded and cut there, and
    only the crops go on. A file that can't be worked on gives one row without ``poly_idx``.
    """
    files = work.where("NOT reused").groupBy(*KEY, "filename", "model", "prompt").agg(F.collect_list(F.struct("poly_idx", "region_order", "box")).alias("regions"))
    files = files.join(pages.groupBy("job_id", "filename").agg(F.first("content", ignorenulls=True).alias("content")), ["job_id", "filename"], "left")
    none = F.create_map().cast("map<string,string>")
    files = files.join(options, "job_id", "left").withColumn("options", F.coalesce("options", none)) if options is not None else files.withColumn("options", none)
    return cut_pages(files)


def ask(work: DataFrame, pages: DataFrame, client: ModelClient, options: DataFrame | None = None, calls: int | None = None) -> DataFrame:
    """(job_id, file_index, poly_idx, region_order, text, ok, error) of the work that isn't reused."""
    return infer(cuts(work, pages, options), client, image="png", calls=calls, broken="error").select(*KEY, "poly_idx", "region_order", "text", "ok", "error")


def run(results: DataFrame, file_polygons: DataFrame, jobs: DataFrame, client: ModelClient, pages: DataFrame, options: DataFrame | None = None, calls: int | None = None, force: bool = False, materialise=written_once) -> DataFrame:
    """(job_id, file_index, extracted_text, regions) of the pending files.

    ``pages`` holds (job_id, filename, content). ``materialise`` writes the inferred rows once (a checkpoint by default) so that no
    later use calls the model again. Files whose regions are all empty get empty text; the text of
    a file that can't be worked on is its error, and its stored regions stay.
    """
    w = work_list(results, file_polygons, jobs, force)
    asked = materialise(ask(w, pages, client, options, calls).select(*KEY, "poly_idx", "region_order", "text"))
    kept = w.where("reused").select(*KEY, "poly_idx", "region_order", F.col("stored").alias("text"))
    texts = asked.unionByName(kept)
    whole = texts.where("poly_idx IS NULL").select(*KEY, F.col("text").alias("whole_text"))
    m = R.regions_map(texts).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("region_order").cast("string").alias("k"), "text")))).alias("regions"))
    files = R.files_of(results if force else results.join(J.pending_files(results).select(*KEY), KEY, "left_semi")).select(*KEY)
    out = files.join(R.assemble(texts), KEY, "left").join(whole, KEY, "left").join(m, KEY, "left")
    return out.select(*KEY, F.coalesce("whole_text", "extracted_text", F.lit("")).alias("extracted_text"), "regions")


def retry_text(current: DataFrame, retried: DataFrame) -> DataFrame:
    """Results whose (job_id, file_index, region_order, text) retries are appended to the text."""
    part = F.concat(F.lit(K.RETRY_HEADER.split("{")[0]), F.col("region_order").cast("string"), F.lit("\n"), F.col("text"))
    r = retried.select(*KEY, F.struct("region_order", part.alias("part")).alias("x")).groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("more"))
    return current.join(r, KEY, "left").withColumn("extracted_text", F.concat(F.coalesce("extracted_text", F.lit("")), F.coalesce("more", F.lit("")))).drop("more")
