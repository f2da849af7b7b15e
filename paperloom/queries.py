"""The document pipeline's queries by name, with equivalent SQL where one exists.

All run over whole tables. Page size for boxes is A4 at 300 dpi (2480 x 3508).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from . import schema
from .functions import scalars as S
from .operators import edits as E
from .operators import images as I
from .operators import inference as N
from .operators import jobs as J
from .operators import models as M
from .operators import pages as P
from .operators import regions as R
from .plans import extract as X
from .session import shared_folder, shipped
from .sinks import documents as D
from .sources.tables import table
from .streaming import ingest as T

WIDTH, HEIGHT = 2480, 3508
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_polygons(*_t(spark, d, "results", "file_polygons", "jobs"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return R.explode_regions(_resolved(spark, d)).where("poly_idx IS NOT NULL")


#: Files once each; polygons per file, else per job; regions exploded with default orders.
FILES = "files AS (SELECT job_id, file_index, min(filename) AS filename FROM results GROUP BY ALL)"
POLYS = FILES + """,
own AS (SELECT DISTINCT job_id, filename, poly_idx, points, region_order, done FROM file_polygons),
has AS (SELECT DISTINCT job_id, filename FROM own),
shared_p AS (SELECT job_id, i - 1 AS poly_idx, polygons[i].points AS points, polygons[i].region_order AS region_order, polygons[i].done AS done
         FROM (SELECT job_id, any_value(polygons) AS polygons FROM jobs WHERE len(polygons) > 0 GROUP BY job_id) j, LATERAL (SELECT unnest(range(1, len(polygons) + 1)) AS i) u),
reg AS (SELECT f.job_id, f.file_index, f.filename, 'file' AS origin, o.poly_idx, o.points, o.region_order, o.done FROM files f JOIN own o USING (job_id, filename)
        UNION ALL
        SELECT f.job_id, f.file_index, f.filename, 'job', g.poly_idx, g.points, g.region_order, g.done FROM files f JOIN shared_p g USING (job_id) LEFT JOIN has h USING (job_id, filename) WHERE h.job_id IS NULL),
regions_x AS (SELECT job_id, file_index, filename, origin, CAST(poly_idx AS INTEGER) AS poly_idx, CAST(coalesce(region_order, poly_idx + 1) AS INTEGER) AS region_order, points, done FROM reg)"""


@query("resolve_polygons", f"WITH {POLYS} SELECT f.job_id, f.file_index, coalesce(min(r.origin), 'whole') AS origin, CAST(count(r.poly_idx) AS INTEGER) AS n_polygons FROM files f LEFT JOIN regions_x r USING (job_id, file_index) GROUP BY 1, 2")
def resolve_polygons(spark, d):
    return _resolved(spark, d).select("job_id", "file_index", "origin", F.size("polygons").alias("n_polygons"))


@query("region_explode", f"WITH {POLYS} SELECT f.job_id, f.file_index, coalesce(r.origin, 'whole') AS origin, r.poly_idx, r.region_order, CAST(len(r.points) AS INTEGER) AS n_points FROM files f LEFT JOIN regions_x r USING (job_id, file_index)")
def region_explode(spark, d):
    return R.explode_regions(_resolved(spark, d)).select("job_id", "file_index", "origin", "poly_idx", "region_order", F.when(F.col("points").isNotNull(), F.size("points")).alias("n_points"))


BOX = f"""WITH {POLYS}, b AS (SELECT job_id, file_index, poly_idx,
  greatest(list_min(list_transform(points, lambda p: p.x * {WIDTH}.0)), 0.0) AS l, greatest(list_min(list_transform(points, lambda p: p.y * {HEIGHT}.0)), 0.0) AS t,
  least(list_max(list_transform(points, lambda p: p.x * {WIDTH}.0)), {WIDTH}.0) AS r, least(list_max(list_transform(points, lambda p: p.y * {HEIGHT}.0)), {HEIGHT}.0) AS b FROM regions_x)
SELECT job_id, file_index, poly_idx, round(l, 4) AS box_left, round(t, 4) AS box_top, round(r, 4) AS box_right, round(b, 4) AS box_bottom FROM b WHERE r > l AND b > t"""


@query("bbox_clamp", BOX)
def bbox_clamp(spark, d):
    b = R.boxes(_regions(spark, d), F.lit(WIDTH), F.lit(HEIGHT))
    return b.select("job_id", "file_index", "poly_idx", *[F.round(f"box.{c}", 4).alias(f"box_{c}") for c in ("left", "top", "right", "bottom")])


@query("box_pages", f"WITH x AS ({BOX}) SELECT job_id, file_index, CAST(count(*) AS BIGINT) AS n_boxes, round(sum((box_right - box_left) * (box_bottom - box_top)) / {WIDTH * HEIGHT}, 3) AS covered FROM x GROUP BY 1, 2")
def box_pages(spark, d):
    return bbox_clamp(spark, d).groupBy("job_id", "file_index").agg(F.count("*").alias("n_boxes"), F.round(F.sum((F.col("box_right") - F.col("box_left")) * (F.col("box_bottom") - F.col("box_top"))) / (WIDTH * HEIGHT), 3).alias("covered"))


STORED = "stored AS (SELECT job_id, file_index, k, max(v) AS v FROM (SELECT job_id, file_index, unnest(map_keys(regions)) AS k, unnest(map_values(regions)) AS v FROM results WHERE regions IS NOT NULL) GROUP BY ALL)"
TEXTS = f"{POLYS}, {STORED}, texts AS (SELECT r.job_id, r.file_index, r.poly_idx, r.region_order, s.v AS text FROM regions_x r JOIN stored s ON s.job_id = r.job_id AND s.file_index = r.file_index AND s.k = CAST(r.region_order AS VARCHAR) WHERE s.v IS NOT NULL)"


def _texts(spark, d):
    """Stored texts of the resolved regions."""
    w = R.needs_model(_regions(spark, d), table(spark, d, "results"))
    return w.where("stored IS NOT NULL").select("job_id", "file_index", "poly_idx", "region_order", F.col("stored").alias("text"))


@query("assemble_text", f"WITH {TEXTS} SELECT job_id, file_index, string_agg('### REGION ' || region_order || chr(10) || text || chr(10) || chr(10), '' ORDER BY poly_idx, text) AS extracted_text FROM texts GROUP BY 1, 2")
def assemble_text(spark, d):
    return R.assemble(_texts(spark, d))


STUB = "'text of ' || filename || '#' || poly_idx"


@query("regions_map_lastwins", f"WITH {POLYS} SELECT job_id, file_index, region_order, arg_max({STUB}, poly_idx) AS text FROM regions_x GROUP BY 1, 2, 3")
def regions_map_lastwins(spark, d):
    x = _regions(spark, d).withColumn("text", F.concat(F.lit("text of "), "filename", F.lit("#"), F.col("poly_idx").cast("string")))
    return R.regions_map(x)


@query("regions_merge", f"""WITH {POLYS}, {STORED}, new AS (SELECT job_id, file_index, CAST(region_order AS VARCHAR) AS k, arg_max({STUB}, poly_idx) AS v FROM regions_x GROUP BY 1, 2, 3)
SELECT job_id, file_index, k, coalesce(n.v, s.v) AS text FROM new n FULL JOIN stored s USING (job_id, file_index, k)""")
def regions_merge(spark, d):
    new = regions_map_lastwins(spark, d).groupBy("job_id", "file_index").agg(F.map_from_entries(F.collect_list(F.struct(F.col("region_order").cast("string").alias("k"), "text"))).alias("new"))
    old = table(spark, d, "results").where("regions IS NOT NULL").select("job_id", "file_index", F.explode("regions").alias("k", "v")).groupBy("job_id", "file_index", "k").agg(F.max("v").alias("v"))
    old = old.groupBy("job_id", "file_index").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("old"))
    none = F.create_map().cast("map<string,string>")
    x = new.join(old, ["job_id", "file_index"], "full")
    return x.select("job_id", "file_index", F.explode(R.merge_regions(F.col("old"), F.coalesce("new", none))).alias("k", "text"))


@query("region_reuse", f"WITH {POLYS}, {STORED} SELECT r.job_id, r.file_index, r.poly_idx, r.region_order, (coalesce(r.done, false) AND s.v IS NOT NULL) AS reused FROM regions_x r LEFT JOIN stored s ON s.job_id = r.job_id AND s.file_index = r.file_index AND s.k = CAST(r.region_order AS VARCHAR)")
def region_reuse(spark, d):
    return R.needs_model(_regions(spark, d), table(spark, d, "results")).select("job_id", "file_index", "poly_idx", "region_order", "reused")


@query("region_view", f"WITH {FILES} SELECT f.job_id, f.file_index, r.v AS first_region FROM files f LEFT JOIN (WITH {STORED} SELECT * FROM stored WHERE k = '1') r USING (job_id, file_index)")
def region_view(spark, d):
    r = table(spark, d, "results")
    return r.groupBy("job_id", "file_index").agg(F.max(R.region_text(F.col("regions"), F.lit(1))).alias("first_region"))


@query("next_order", "SELECT job_id, filename, CAST(coalesce(max(coalesce(region_order, poly_idx + 1)), 0) + 1 AS INTEGER) AS next_order FROM file_polygons GROUP BY 1, 2")
def next_order(spark, d):
    return R.next_order(table(spark, d, "file_polygons"))


@query("sorted_polygons", f"WITH {POLYS} SELECT job_id, file_index, string_agg(region_order || ':' || poly_idx, ',' ORDER BY region_order, poly_idx) AS orders FROM regions_x GROUP BY 1, 2")
def sorted_polygons(spark, d):
    x = _resolved(spark, d).where("size(polygons) > 0")
    s = F.transform(R.sorted_polygons(F.col("polygons")), lambda p: F.concat(p["region_order"].cast("string"), F.lit(":"), p["poly_idx"].cast("string")))
    return x.select("job_id", "file_index", F.array_join(s, ",").alias("orders"))


@query("points_inside", "SELECT job_id, filename, poly_idx, CAST(sum(CASE WHEN p.x BETWEEN 0 AND 1 AND p.y BETWEEN 0 AND 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside FROM (SELECT job_id, filename, poly_idx, unnest(points) AS p FROM (SELECT DISTINCT * FROM file_polygons)) GROUP BY 1, 2, 3")
def points_inside(spark, d):
    x = table(spark, d, "file_polygons").distinct().select("job_id", "filename", "poly_idx", F.explode("points").alias("p"))
    return x.groupBy("job_id", "filename", "poly_idx").agg(F.sum(R.inside_page(F.col("p.x"), F.col("p.y")).cast("bigint")).alias("n_inside"))


@query("file_tree", f"WITH {POLYS} SELECT job_id, file_index, -1 AS poly_idx, filename AS label FROM files UNION ALL SELECT job_id, file_index, poly_idx, 'Region ' || region_order FROM regions_x")
def file_tree(spark, d):
    return R.tree(_resolved(spark, d))


@query("progress", f"WITH {FILES} SELECT job_id, file_index, count(*) OVER (PARTITION BY job_id) AS n_files, CAST(trunc(row_number() OVER (PARTITION BY job_id ORDER BY file_index) / CAST(count(*) OVER (PARTITION BY job_id) AS DOUBLE) * 100) AS INTEGER) AS progress FROM files")
def progress(spark, d):
    return R.progress(table(spark, d, "results"))


@query("job_list", "SELECT DISTINCT job_id AS id, status, progress, coalesce(name, right(job_id, 4)) AS name FROM jobs")
def job_list(spark, d):
    return J.list_jobs(table(spark, d, "jobs"))


@query("job_counts", f"WITH {FILES}, p AS (SELECT job_id, count(DISTINCT page_no) AS n_pages FROM final_pages GROUP BY 1) SELECT f.job_id, count(*) AS n_files, coalesce(max(p.n_pages), 0) AS n_pages FROM files f LEFT JOIN p USING (job_id) GROUP BY 1")
def job_counts(spark, d):
    r, p = _t(spark, d, "results", "final_pages")
    n = p.groupBy("job_id").agg(F.countDistinct("page_no").alias("n_pages"))
    return R.files_of(r).groupBy("job_id").agg(F.count("*").alias("n_files")).join(n, "job_id", "left").select("job_id", "n_files", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


PENDING = "pending AS (SELECT job_id, file_index, min(filename) AS filename FROM results GROUP BY 1, 2 HAVING NOT bool_or(coalesce(done, false)))"


@query("done_skip", f"WITH {PENDING} SELECT * FROM pending")
def done_skip(spark, d):
    return J.pending_files(table(spark, d, "results"))


@query("queue_order", f"WITH {PENDING} SELECT job_id, file_index, filename, CAST(row_number() OVER (PARTITION BY job_id ORDER BY file_index) AS INTEGER) AS slot FROM pending WHERE job_id IN (SELECT job_id FROM jobs WHERE status = 'queued')")
def queue_order(spark, d):
    return J.queue_order(*_t(spark, d, "jobs", "results"))


@query("status_derive", """WITH f AS (SELECT job_id, file_index, bool_or(coalesce(done, false) OR length(coalesce(extracted_text, '')) > 0) AS ready,
  bool_or(regexp_matches(coalesce(extracted_text, ''), '^(?:## Extracted by [^' || chr(10) || ']+' || chr(10) || chr(10) || ')?\\[(?:Ollama Error|Error processing)')) AS failed FROM results GROUP BY 1, 2),
n AS (SELECT job_id, count(*) AS n_files, count_if(ready) AS n_done, count_if(failed) AS n_failed FROM f GROUP BY 1),
j AS (SELECT job_id, coalesce(n_files, 0) AS n_files, coalesce(CAST(n_done AS BIGINT), 0) AS n_done, coalesce(CAST(n_failed AS BIGINT), 0) AS n_failed FROM (SELECT DISTINCT job_id FROM jobs) LEFT JOIN n USING (job_id))
SELECT *, CASE WHEN n_files > 0 AND n_failed = n_files THEN 'failed' WHEN n_done = n_files THEN 'completed' ELSE 'queued' END AS status FROM j""")
def status_derive(spark, d):
    return J.derive_status(*_t(spark, d, "jobs", "results"))


SETTINGS = "(SELECT DISTINCT job_id, 'model_version' AS key, model_version AS value FROM jobs UNION SELECT DISTINCT job_id, 'prompt', prompt FROM jobs UNION SELECT DISTINCT job_id, 'status', status FROM jobs)"


@query("settings_merge", f"""WITH p AS (SELECT job_id, 'model_version' AS key, model AS value, requested_at AS ts FROM translation_requests UNION ALL SELECT job_id, 'tone', tone, requested_at FROM translation_requests),
e AS (SELECT job_id, key, value, NULL::TIMESTAMP WITH TIME ZONE AS ts FROM {SETTINGS} UNION ALL SELECT * FROM p)
SELECT job_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY job_id, key ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST) AS n FROM e) WHERE n = 1""")
def settings_merge(spark, d):
    j, q = _t(spark, d, "jobs", "translation_requests")
    keys = ("model_version", "prompt", "status")
    s = j.distinct().select("job_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("x")).select("job_id", "x.key", "x.value").distinct()
    p = q.select("job_id", F.explode(F.array(F.struct(F.lit("model_version").alias("key"), F.col("model").alias("value")), F.struct(F.lit("tone").alias("key"), F.col("tone").alias("value")))).alias("x"), F.col("requested_at").alias("ts")).select("job_id", "x.key", "x.value", "ts")
    return J.merge_settings(s, p)


COLLAPSED = "last AS (SELECT job_id, file_index, field, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id, file_index, field ORDER BY ts DESC, value DESC) AS n FROM (SELECT job_id, file_index, ts, CASE field WHEN 'text' THEN 'extracted_text' ELSE field END AS field, value FROM edits WHERE value IS NOT NULL)) WHERE n = 1)"


@query("edit_collapse", f"WITH {COLLAPSED} SELECT job_id, file_index, field, value FROM last")
def edit_collapse(spark, d):
    return E.collapse(table(spark, d, "edits")).drop("ts")


@query("apply_edits", f"WITH {COLLAPSED}, r AS (SELECT job_id, file_index, max(extracted_text) AS e, max(translation) AS t FROM results GROUP BY 1, 2) SELECT r.job_id, r.file_index, coalesce(a.value, r.e) AS extracted_text, coalesce(b.value, r.t) AS translation FROM r LEFT JOIN last a ON a.job_id = r.job_id AND a.file_index = r.file_index AND a.field = 'extracted_text' LEFT JOIN last b ON b.job_id = r.job_id AND b.file_index = r.file_index AND b.field = 'translation'")
def apply_edits(spark, d):
    r, e = _t(spark, d, "results", "edits")
    return E.apply(r.groupBy("job_id", "file_index").agg(F.max("extracted_text").alias("extracted_text"), F.max("translation").alias("translation")), e)


@query("rename_jobs", "SELECT DISTINCT j.job_id, CASE WHEN f.job_id IS NULL THEN j.name WHEN length(trim(coalesce(f.n, ''))) > 0 THEN f.n ELSE j.job_id END AS name FROM jobs j LEFT JOIN (SELECT job_id, max(text[1:20]) AS n FROM final_pages GROUP BY 1) f USING (job_id)")
def rename_jobs(spark, d):
    j, p = _t(spark, d, "jobs", "final_pages")
    return J.rename(j, p.select("job_id", F.substring("text", 1, 20).alias("name"))).select("job_id", "name")


@query("delete_jobs", "SELECT job_id, file_index, count(*) AS n FROM results WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'queued') GROUP BY 1, 2")
def delete_jobs(spark, d):
    r, j = _t(spark, d, "results", "jobs")
    return J.delete_jobs(r, j.where("status = 'queued'")).groupBy("job_id", "file_index").agg(F.count("*").alias("n"))


@query("append_files", """WITH new AS (SELECT DISTINCT job_id, filename || '.more' AS filename FROM results WHERE filename LIKE '%7.png'), last AS (SELECT job_id, max(file_index) + 1 AS start FROM results GROUP BY 1)
SELECT DISTINCT job_id, file_index, filename FROM results UNION ALL SELECT job_id, CAST(start + row_number() OVER (PARTITION BY job_id ORDER BY filename) - 1 AS INTEGER), filename FROM new JOIN last USING (job_id)""")
def append_files(spark, d):
    r = table(spark, d, "results")
    new = r.where("filename LIKE '%7.png'").select("job_id", F.concat("filename", F.lit(".more")).alias("filename")).distinct()
    once = r.select("job_id", "file_index", "filename").distinct().select("*", F.lit(None).cast("map<string,string>").alias("regions"), F.lit(None).cast("string").alias("extracted_text"), F.lit(None).cast("string").alias("translation"), F.lit(None).cast("boolean").alias("done"))
    return J.add_files(once, new).select("job_id", "file_index", "filename")


@query("remove_renumber", f"WITH {FILES}, doomed AS (SELECT DISTINCT job_id, file_index FROM results WHERE extracted_text IS NULL OR extracted_text = '') SELECT f.job_id, CAST(row_number() OVER (PARTITION BY f.job_id ORDER BY f.file_index) - 1 AS INTEGER) AS file_index, f.file_index AS old_index, f.filename FROM files f LEFT JOIN doomed x USING (job_id, file_index) WHERE x.job_id IS NULL")
def remove_renumber(spark, d):
    r = table(spark, d, "results")
    return J.remove_files(R.files_of(r), r.where("extracted_text IS NULL OR extracted_text = ''"))


@query("import_id_suffix", """WITH ids AS (SELECT DISTINCT job_id FROM jobs), n AS (SELECT regexp_extract(job_id, '^(.*)_(\\d+)$', 1) AS orig, try_cast(regexp_extract(job_id, '^(.*)_(\\d+)$', 2) AS INTEGER) AS n FROM ids), s AS (SELECT orig, list(DISTINCT n) AS ns FROM n WHERE orig <> '' AND n > 0 GROUP BY 1)
SELECT i.job_id, i.job_id || '_' || CASE WHEN s.ns IS NULL THEN 1 ELSE list_min(list_filter(range(1, len(s.ns) + 2), lambda x: NOT list_contains(s.ns, x))) END AS new_id FROM ids i LEFT JOIN s ON s.orig = i.job_id""")
def import_id_suffix(spark, d):
    j = table(spark, d, "jobs")
    return J.import_ids(j, j)


@query("unique_names", f"WITH {FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id, filename ORDER BY file_index) - 1 AS n FROM files) SELECT job_id, file_index, filename, CASE WHEN n = 0 THEN filename ELSE regexp_extract(filename, '^(.*?)(\\.[^.]*)?$', 1) || '_' || n || regexp_extract(filename, '(\\.[^.]*)$', 1) END AS staged FROM n")
def unique_names(spark, d):
    return J.unique_names(R.files_of(table(spark, d, "results")))


@query("processed_names", "SELECT DISTINCT filename, regexp_replace(filename, '\\.[^/.]+$', '') || '_processed.png' AS processed, regexp_extract('a/b/' || filename, '[^/]*$') AS base FROM results")
def processed_names(spark, d):
    f = table(spark, d, "results").select("filename").distinct()
    return f.select("filename", S.processed_name(F.col("filename")).alias("processed"), S.basename(F.concat(F.lit("a/b/"), "filename")).alias("base"))


@query("log_tail_50", "SELECT strftime(ts AT TIME ZONE 'UTC', '%H:%M:%S') AS time, level, msg FROM (SELECT DISTINCT ts, upper(coalesce(level, 'INFO')) AS level, msg FROM logs ORDER BY ts DESC, msg DESC, level DESC LIMIT 50)")
def log_tail_50(spark, d):
    return J.log_tail(table(spark, d, "logs"), K.LOG_KEEP).select("time", "level", "msg")


@query("log_days", "SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, level, count(*) AS n FROM (SELECT DISTINCT ts, upper(coalesce(level, 'INFO')) AS level, msg FROM logs) GROUP BY 1, 2")
def log_days(spark, d):
    x = table(spark, d, "logs").select("ts", F.upper(F.coalesce("level", F.lit("INFO"))).alias("level"), "msg").distinct()
    return x.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "level").agg(F.count("*").alias("n"))


@query("model_label", "SELECT DISTINCT name, upper(list_extract(string_split(string_split(name, ':')[1], '/'), -1)) AS label, regexp_matches(name, 'qwen|llama|mistral|gemma') AS translates FROM models")
def model_label(spark, d):
    return M.labelled(table(spark, d, "models"))


_REQ = ", ".join(f"('{a}', '{b}')" for a, b in K.REQUIRED_MODELS)


@query("model_integrity", f"SELECT r.id, r.label, EXISTS (SELECT 1 FROM models m WHERE contains(m.name, string_split(r.id, ':')[1])) AS ready FROM (VALUES {_REQ}) r(id, label)")
def model_integrity(spark, d):
    return M.integrity(spark, table(spark, d, "models"))


_SPECS = ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in K.MODEL_PARAMS)


@query("model_params", f"WITH s(model, param, label, type, low, high, step, value) AS (VALUES {_SPECS}), m AS (SELECT DISTINCT name FROM models UNION SELECT 'x/german-ocr-3.1:latest') SELECT m.name, s.param, s.label, s.type, s.low, s.high, s.step, s.value FROM m JOIN s ON s.model = list_extract(string_split(string_split(m.name, ':')[1], '/'), -1)")
def model_params(spark, d):
    m = table(spark, d, "models").unionByName(spark.createDataFrame([("x/german-ocr-3.1:latest",)], "name string"))
    return M.parameters(spark, m, untagged=True)


@query("translator_models", "SELECT model, count(*) AS n, CAST(sum(CASE WHEN model IN (SELECT name FROM models) THEN 1 ELSE 0 END) AS BIGINT) AS n_installed FROM (SELECT DISTINCT job_id, file_index, model FROM translation_requests) GROUP BY 1")
def translator_models(spark, d):
    q, m = _t(spark, d, "translation_requests", "models")
    x = q.select("job_id", "file_index", "model").distinct().join(m.select(F.col("name").alias("model"), F.lit(1).alias("hit")).distinct(), "model", "left")
    return x.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0)).cast("bigint")).alias("n_installed"))


@query("extract_header", f"WITH {FILES} SELECT f.job_id, f.file_index, '## Extracted by ' || coalesce(j.m, '') || ' (Ollama)' || chr(10) || chr(10) || f.filename AS text FROM files f LEFT JOIN (SELECT job_id, max(model_version) AS m FROM jobs GROUP BY 1) j USING (job_id)")
def extract_header(spark, d):
    r, j = _t(spark, d, "results", "jobs")
    m = j.groupBy("job_id").agg(F.max("model_version").alias("m"))
    return R.files_of(r).join(m, "job_id", "left").select("job_id", "file_index", S.extract_header(F.coalesce("m", F.lit("")), F.col("filename")).alias("text"))


@query("translate_prompt", "SELECT DISTINCT q.job_id, q.file_index, q.model, 'You are a professional translator. Translate the text into ' || q.target_lang || ' with a ' || coalesce(q.tone, 'Professional') || ' tone. Output ONLY the translated text. Do not add explanations or preambles.' AS system, '<source_document>' || chr(10) || coalesce(r.b, '') || chr(10) || '</source_document>' AS user FROM translation_requests q JOIN (SELECT job_id, file_index, max(extracted_text) AS b FROM results GROUP BY 1, 2) r USING (job_id, file_index)")
def translate_prompt(spark, d):
    return N.translation_prompts(*_t(spark, d, "translation_requests", "results"))


@query("page_lines", "SELECT job_id, page_no, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT DISTINCT job_id, page_no, string_split(coalesce(text, ''), chr(10)) AS l FROM final_pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u")
def page_lines(spark, d):
    return P.lines(table(spark, d, "final_pages"))


@query("pdf_sheets", "SELECT job_id, page_no, CAST(i - 1 AS INTEGER) AS line_no, CAST((i - 1) // 54 AS INTEGER) AS sheet, CAST(20 + 5 * ((i - 1) % 54) AS INTEGER) AS y FROM (SELECT DISTINCT job_id, page_no, string_split(coalesce(text, ''), chr(10)) AS l FROM final_pages), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u")
def pdf_sheets(spark, d):
    return P.paginate(P.lines(table(spark, d, "final_pages"))).drop("line")


@query("batch_text_export", "SELECT job_id, string_agg('--- ' || coalesce(filename, '') || ' ---' || chr(10) || chr(10) || t || chr(10) || chr(10), '' ORDER BY file_index) AS body FROM (SELECT job_id, file_index, min(filename) AS filename, max(coalesce(extracted_text, '')) AS t FROM results GROUP BY 1, 2) GROUP BY 1")
def batch_text_export(spark, d):
    return D.batch_text(table(spark, d, "results"))


@query("page_files", "SELECT DISTINCT p.job_id, p.page_no, coalesce(j.name, 'page') || '_' || p.page_no || '.txt' AS file FROM final_pages p LEFT JOIN (SELECT job_id, max(name) AS name FROM jobs GROUP BY 1) j USING (job_id)")
def page_files(spark, d):
    p, j = _t(spark, d, "final_pages", "jobs")
    n = j.groupBy("job_id").agg(F.max("name").alias("name"))
    return p.select("job_id", "page_no").distinct().join(n, "job_id", "left").select("job_id", "page_no", D.page_file_name(F.col("name"), F.col("page_no")).alias("file"))


PAGES = "pages AS (SELECT job_id, list(t ORDER BY page_no) AS pages FROM (SELECT job_id, page_no, max(coalesce(text, '')) AS t FROM final_pages GROUP BY 1, 2) GROUP BY 1)"


@query("final_page_edit", f"WITH {PAGES} SELECT job_id, CAST(len(pages) AS INTEGER) AS n, array_to_string([pages[1], 'new'] || pages[2:], '|') AS inserted, CASE WHEN len(pages) <= 1 THEN '' ELSE array_to_string(pages[2:], '|') END AS deleted, array_to_string(['set'] || pages[2:], '|') AS changed FROM pages")
def final_page_edit(spark, d):
    p = P.page_lists(table(spark, d, "final_pages"))
    join = lambda c: F.array_join(c, "|")
    return p.select("job_id", F.size("pages").alias("n"), join(P.insert_after(F.col("pages"), 1, "new")).alias("inserted"), join(P.delete_at(F.col("pages"), 1)).alias("deleted"), join(P.set_at(F.col("pages"), 1, F.lit("set"))).alias("changed"))


@query("page_clamp", f"WITH {PAGES} SELECT job_id, CAST(least(greatest(coalesce(try_cast(regexp_extract(right(job_id, 2) || 'a', '^\\s*([+-]?\\d+)', 1) AS INTEGER), 1), 1), len(pages)) AS INTEGER) AS page FROM pages")
def page_clamp(spark, d):
    p = P.page_lists(table(spark, d, "final_pages"))
    return p.select("job_id", S.page_choice(F.concat(F.substring("job_id", -2, 2), F.lit("a")), F.size("pages")).alias("page"))


@query("preprocess_params", """WITH x AS (SELECT DISTINCT job_id, file_index, 600 + file_index * 37 % 4000 AS height, 500 + file_index * 53 % 3000 AS width, 150 * CAST(pow(2, file_index % 3) AS INTEGER) AS dpi FROM results),
t AS (SELECT *, CAST(floor(8.27::DOUBLE * dpi) AS INTEGER) AS target FROM x), s AS (SELECT *, target / CAST(least(height, width) AS DOUBLE) AS scale, CAST(floor(target / 40.0::DOUBLE) AS INTEGER) AS b FROM t)
SELECT job_id, file_index, target, CAST(CASE WHEN scale <> 1 AND scale > 0.1 THEN floor(height * scale) ELSE height END AS INTEGER) AS out_height, CAST(CASE WHEN scale <> 1 AND scale > 0.1 THEN floor(width * scale) ELSE width END AS INTEGER) AS out_width, CAST(greatest(b + CASE WHEN b % 2 = 0 THEN 1 ELSE 0 END, 11) AS INTEGER) AS block FROM s""")
def preprocess_params(spark, d):
    x = table(spark, d, "results").select("job_id", "file_index").distinct()
    i = F.col("file_index")
    x = x.withColumns({"height": F.lit(600) + i * 37 % 4000, "width": F.lit(500) + i * 53 % 3000, "dpi": F.lit(150) * F.pow(F.lit(2), i % 3).cast("int")})
    out = None
    for dpi in K.DPI_CHOICES:
        part = I.plan_sizes(x.where(F.col("dpi") == dpi), dpi)
        out = part if out is None else out.unionByName(part)
    return out.select("job_id", "file_index", "target", "out_height", "out_width", "block")


@query("threshold_vectors")
def threshold_vectors(spark, d):
    return I.threshold_vectors(table(spark, d, "embeddings"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A white page for each file, PNG, of a size that follows from the file's name."""

    def draw(batches):
        for pdf in batches:
            yield pdf.assign(content=[I.encode_png(np.full((80 + 2 * len(n), 60 + 3 * len(n)), 255, np.uint8)) for n in pdf["filename"]])

    return table(spark, d, "results").where("filename IS NOT NULL").select("job_id", "filename").distinct().mapInPandas(draw, "job_id string, filename string, content binary")


#: Crops in pixels of the drawn pages, and what the echoing client says of them.
CROPS = f"""{POLYS}, {STORED}, model AS (SELECT job_id, coalesce(max(model_version), 'unknown') AS model, coalesce(max(prompt), '') AS prompt FROM jobs GROUP BY 1),
unit AS (SELECT x.*, 60 + 3 * length(filename) AS w, 80 + 2 * length(filename) AS h, greatest(list_min(list_transform(points, lambda p: p.x * 1.0)), 0.0) AS l, greatest(list_min(list_transform(points, lambda p: p.y * 1.0)), 0.0) AS t,
  least(list_max(list_transform(points, lambda p: p.x * 1.0)), 1.0) AS r, least(list_max(list_transform(points, lambda p: p.y * 1.0)), 1.0) AS b FROM regions_x x),
cut AS (SELECT u.job_id, u.file_index, u.filename, u.poly_idx, u.region_order, CAST(ceil(r * w) - floor(l * w) AS INTEGER) AS cw, CAST(ceil(b * h) - floor(t * h) AS INTEGER) AS ch, s.v AS stored, (coalesce(u.done, false) AND s.v IS NOT NULL) AS reused
  FROM unit u LEFT JOIN stored s ON s.job_id = u.job_id AND s.file_index = u.file_index AND s.k = CAST(u.region_order AS VARCHAR) WHERE r > l AND b > t),
asked AS (SELECT job_id, file_index, poly_idx, region_order, cw, ch FROM cut WHERE NOT reused
  UNION ALL SELECT f.job_id, f.file_index, NULL, NULL, 60 + 3 * length(f.filename), 80 + 2 * length(f.filename) FROM files f LEFT JOIN regions_x x USING (job_id, file_index) WHERE x.job_id IS NULL),
echo AS (SELECT a.*, coalesce(m.model, 'unknown') AS model, cw || 'x' || ch || ' ' || md5(coalesce(m.prompt, '')) AS said FROM asked a LEFT JOIN model m USING (job_id))"""
SAID = "'## Extracted by ' || model || ' (Ollama)' || chr(10) || chr(10) || said"
FAILED = "'status ' || (500 + cw % 4) || ' for chat call'"


@query("run_batch", f"""WITH {CROPS}, {PENDING}, texts AS (SELECT job_id, file_index, poly_idx, region_order, CASE WHEN cw * ch % 97 = 0 THEN '[Ollama Error: ' || {FAILED} || ']' ELSE {SAID} END AS text FROM echo
  UNION ALL SELECT job_id, file_index, poly_idx, region_order, stored FROM cut WHERE reused)
SELECT p.job_id, p.file_index, coalesce(max(text) FILTER (poly_idx IS NULL), string_agg('### REGION ' || region_order || chr(10) || text || chr(10) || chr(10), '' ORDER BY poly_idx, '### REGION ' || region_order || chr(10) || text || chr(10) || chr(10)), '') AS extracted_text, CAST(count(DISTINCT region_order) AS INTEGER) AS n_regions
FROM pending p LEFT JOIN texts t USING (job_id, file_index) GROUP BY 1, 2""")
def run_batch(spark, d):
    r, p, j = _t(spark, d, "results", "file_polygons", "jobs")
    return X.run(r, p, j, N.EchoClient(fail_on=97), _pages(spark, d)).select("job_id", "file_index", "extracted_text", F.coalesce(F.when(F.col("regions").isNotNull(), F.size("regions")), F.lit(0)).alias("n_regions"))


@query("error_render", f"WITH {CROPS} SELECT job_id, file_index, poly_idx, CASE WHEN cw * ch % 10 = 0 THEN '[Ollama Error: ' || {FAILED} || ']' ELSE {SAID} END AS text, cw * ch % 10 <> 0 AS ok, CASE WHEN cw * ch % 10 = 0 THEN {FAILED} END AS error FROM echo")
def error_render(spark, d):
    r, p, j = _t(spark, d, "results", "file_polygons", "jobs")
    return X.ask(X.work_list(r, p, j, force=True), _pages(spark, d), N.EchoClient(fail_on=10)).drop("region_order")


@query("file_errors", f"WITH {FILES} SELECT job_id, file_index, '[Error processing ' || filename || ': cannot identify image file]' AS extracted_text FROM files WHERE filename IS NOT NULL")
def file_errors(spark, d):
    """Every file as a page that is no picture: one rendered error per file, no call of the model."""
    r = table(spark, d, "results").where("filename IS NOT NULL")
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.1), (0.6, 0.1), (0.6, 0.7))])
    p = r.select("job_id", "filename").distinct().select("job_id", "filename", F.lit(0).alias("poly_idx"), square.alias("points"), F.lit(1).alias("region_order"), F.lit(False).alias("done"))
    bad = r.select("job_id", "filename", F.encode(F.lit("no picture"), "UTF-8").alias("content"))
    return X.run(r, p, table(spark, d, "jobs"), N.EchoClient(), bad, force=True).select("job_id", "file_index", "extracted_text")


@query("translate_batch", "WITH p AS (" + SQL["translate_prompt"] + ") SELECT job_id, file_index, model, CASE WHEN left(md5(system || \"user\"), 1) = '0' THEN '[Translation Error: read timed out]' ELSE md5(system || \"user\") END AS translation, left(md5(system || \"user\"), 1) <> '0' AS ok FROM p")
def translate_batch(spark, d):
    return N.translate(translate_prompt(spark, d), N.EchoClient(fail_on=1)).select("job_id", "file_index", "model", "translation", "ok")


@query("retry_append", f"WITH {FILES}, r AS (SELECT job_id, file_index, max(extracted_text) AS e FROM results GROUP BY 1, 2) SELECT job_id, file_index, coalesce(e, '') || chr(10) || chr(10) || '### RETRIED REGION 1' || chr(10) || filename AS extracted_text FROM r JOIN files USING (job_id, file_index)")
def retry_append(spark, d):
    r = table(spark, d, "results")
    again = R.files_of(r).select("job_id", "file_index", F.lit(1).alias("region_order"), F.col("filename").alias("text"))
    return X.retry_text(r.groupBy("job_id", "file_index").agg(F.max("extracted_text").alias("extracted_text")), again)


def _drain(stream: DataFrame, mode: str, out_schema) -> DataFrame:
    """Runs a stream over what is there; returns the table that its sink wrote."""
    spark = stream.sparkSession
    base = shared_folder(spark)
    import uuid

    at = f"{base}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out_schema).parquet(f"{at}/out")


@query("stream_edits", SQL["edit_collapse"])
def stream_edits(spark, d):
    s = T.latest_edits(T.stream_table(spark, f"{d}/edits.parquet", schema.EDITS)).drop("ts")
    return _drain(s, "complete", s.schema)


@query("stream_log_days", "SELECT date_trunc('day', ts AT TIME ZONE 'UTC') AS start, level, count(*) AS n FROM (SELECT DISTINCT ts, upper(coalesce(level, 'INFO')) AS level, msg FROM logs) GROUP BY 1, 2")
def stream_log_days(spark, d):
    s = T.log_counts(T.stream_table(spark, f"{d}/logs.parquet", schema.LOGS), late=None)
    return _drain(s, "complete", s.schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: shipped(f) for k, f in Q.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
