"""Regions: resolving polygons, exploding files, boxes, and assembling text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from .numbering import number_block, positions

KEY = ["job_id", "file_index"]


def files_of(results: DataFrame) -> DataFrame:
    """One row per (job_id, file_index) with its file name, however often a row is repeated."""
    return results.groupBy(*KEY).agg(F.min("filename").alias("filename"))


def polygons_by_file(file_polygons: DataFrame) -> DataFrame:
    """(job_id, filename, polygons): distinct polygons in the order of ``poly_idx``.

    A file's polygons are few by nature (they are drawn on one page), so one array per
    file is bounded; the group key is the file, not the job, so a large job is spread.
    """
    p = F.struct("poly_idx", "points", "region_order", "done")
    return file_polygons.groupBy("job_id", "filename").agg(F.array_sort(F.collect_set(p)).alias("polygons"))


def global_polygons(jobs: DataFrame) -> DataFrame:
    """(job_id, shared): a job's own polygons in the same form."""
    q = F.transform("polygons", lambda p, i: F.struct(i.cast("int").alias("poly_idx"), p["points"].alias("points"), p["region_order"].alias("region_order"), p["done"].alias("done")))
    return jobs.groupBy("job_id").agg(F.first("polygons", ignorenulls=True).alias("polygons")).select("job_id", q.alias("shared"))


def resolve_polygons(results: DataFrame, file_polygons: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, file_index, filename, polygons, origin): the file's own polygons, else the job's.

    Missing and empty both fall back; files without any polygon have an empty array and
    origin ``whole``.
    """
    f = files_of(results).join(polygons_by_file(file_polygons), ["job_id", "filename"], "left").join(global_polygons(jobs), "job_id", "left")
    own, shared = F.size(F.coalesce("polygons", F.array())) > 0, F.size(F.coalesce("shared", F.array())) > 0
    empty = F.array().cast("array<struct<poly_idx:int,points:array<struct<x:double,y:double>>,region_order:int,done:boolean>>")
    return f.select(
        *KEY, "filename",
        F.when(own, F.col("polygons")).when(shared, F.col("shared")).otherwise(empty).alias("polygons"),
        F.when(own, "file").when(shared, "job").otherwise("whole").alias("origin"),
    )


def explode_regions(resolved: DataFrame) -> DataFrame:
    """One row per region; a file without polygons is one whole-file row with null ``poly_idx``.

    ``region_order`` defaults to the position plus one.
    """
    return resolved.select(*KEY, "filename", "origin", F.explode_outer("polygons").alias("p")).select(
        *KEY, "filename", "origin", F.col("p.poly_idx").alias("poly_idx"), F.coalesce("p.region_order", F.col("p.poly_idx") + 1).alias("region_order"), "p.points", "p.done"
    )


def box(points: Column, width: Column, height: Column) -> Column:
    """Bounding box of normalised points on a page, held to the page."""
    at = lambda f, k, size: f(F.transform(points, lambda p: p[k] * size))
    zero = F.lit(0.0)
    return F.struct(
        F.greatest(at(F.array_min, "x", width), zero).alias("left"), F.greatest(at(F.array_min, "y", height), zero).alias("top"),
        F.least(at(F.array_max, "x", width), width).alias("right"), F.least(at(F.array_max, "y", height), height).alias("bottom"),
    )


def boxes(regions: DataFrame, width: Column, height: Column) -> DataFrame:
    """Regions with a box of some area; the others are dropped."""
    return regions.withColumn("box", box(F.col("points"), width.cast("double"), height.cast("double"))).where("box.right > box.left AND box.bottom > box.top")


def inside_page(x: Column, y: Column) -> Column:
    """Whether a click lies in the unit square."""
    return x.between(0, 1) & y.between(0, 1)


def sorted_polygons(polygons: Column) -> Column:
    """Polygons by order, then by position."""
    return F.array_sort(F.transform(polygons, lambda p: F.struct(F.coalesce(p["region_order"], p["poly_idx"] + 1).alias("region_order"), p["poly_idx"].alias("poly_idx"))))


def next_order(file_polygons: DataFrame) -> DataFrame:
    """The order a new region of a file gets: one more than the highest in use."""
    p = file_polygons.select("job_id", "filename", F.coalesce("region_order", F.col("poly_idx") + 1).alias("o"))
    return p.groupBy("job_id", "filename").agg((F.coalesce(F.max("o"), F.lit(0)) + 1).cast("int").alias("next_order"))


def needs_model(regions: DataFrame, results: DataFrame) -> DataFrame:
    """Regions with ``reused``: done regions whose text is stored keep it, no model is asked."""
    stored = results.where("regions IS NOT NULL").select(*KEY, F.explode("regions").alias("k", "stored")).groupBy(*KEY, "k").agg(F.max("stored").alias("stored"))
    x = regions.withColumn("k", F.col("region_order").cast("string")).join(stored, [*KEY, "k"], "left").drop("k")
    return x.withColumn("reused", F.coalesce(F.col("done"), F.lit(False)) & F.col("stored").isNotNull())


def assemble(texts: DataFrame) -> DataFrame:
    """(job_id, file_index, extracted_text) from (poly_idx, region_order, text) rows.

    Texts follow the polygons' positions and carry their order; equal orders all appear.
    """
    part = F.concat(S.template(K.REGION_HEADER, order=F.col("region_order").cast("string")), F.col("text"), F.lit("\n\n"))
    rows = texts.where("poly_idx IS NOT NULL").select(*KEY, F.struct("poly_idx", part.alias("part")).alias("x"))
    return rows.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("extracted_text"))


def regions_map(texts: DataFrame) -> DataFrame:
    """(job_id, file_index, region_order, text): of equal orders the last position's text."""
    return texts.where("poly_idx IS NOT NULL").groupBy(*KEY, "region_order").agg(F.max_by("text", "poly_idx").alias("text"))


def merge_regions(old: Column, new: Column, prune_stale: bool = False) -> Column:
    """New texts over old ones by key; stale keys stay unless they are to be pruned."""
    if prune_stale:
        return new
    keep = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(keep, new)


def region_text(regions: Column, order: Column) -> Column:
    return F.try_element_at(regions, order.cast("string"))


def tree(resolved: DataFrame) -> DataFrame:
    """Rows of a job's tree: each file, then its regions; ``poly_idx`` -1 is the file."""
    files = resolved.select(*KEY, F.lit(-1).alias("poly_idx"), F.col("filename").alias("label"))
    r = explode_regions(resolved).where("poly_idx IS NOT NULL").select(*KEY, "poly_idx", F.concat(F.lit("Region "), F.col("region_order").cast("string")).alias("label"))
    return files.unionByName(r)


def progress(results: DataFrame) -> DataFrame:
    """(job_id, file_index, n_files, progress): percent after each file, cut to whole numbers."""
    f = positions(files_of(results), "job_id", ["file_index"], number_block("file_index"), total="n_files")
    return f.select(*KEY, "n_files", (F.col("pos") / F.col("n_files").cast("double") * 100).cast("int").alias("progress"))
