"""The library's surface: one method per thing a user of the workbench can do.

State is a folder of versioned tables; a change writes a new version of the tables it
touches, so readers always see whole snapshots and a failed change leaves the last one.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import constants as K
from . import schema
from .operators import edits as E
from .operators import images as I
from .operators import inference as N
from .operators import jobs as J
from .operators import models as M
from .operators import regions as R
from .plans import extract as X
from .session import ship
from .sinks import documents as D
from .sources import jobzip

TABLES = ("jobs", "results", "file_polygons", "edits", "logs", "final_pages", "settings", "files")
EXTRA = {"settings": "job_id STRING, key STRING, value STRING, ts TIMESTAMP", "files": "job_id STRING, filename STRING, content BINARY"}


#: What an archive holds of a job beside its own row: table -> columns.
ARCHIVED = {
    "results": ["file_index", "filename", "regions", "extracted_text", "translation", "done"], "file_polygons": ["filename", "poly_idx", "points", "region_order", "done"],
    "edits": ["file_index", "ts", "field", "value"], "final_pages": ["page_no", "text"], "settings": ["key", "value", "ts"],
}
#: The JSON of a job in an archive; region maps are JSON inside it.
ARCHIVE = (
    f"name: STRING, status: STRING, progress: INT, model_version: STRING, prompt: STRING, confidence_threshold: DOUBLE, polygons: ARRAY<{schema.POLYGON}>, "
    "results: ARRAY<STRUCT<file_index: INT, filename: STRING, regions: STRING, extracted_text: STRING, translation: STRING, done: BOOLEAN>>, "
    f"file_polygons: ARRAY<STRUCT<filename: STRING, poly_idx: INT, points: {schema.POINTS}, region_order: INT, done: BOOLEAN>>, "
    "edits: ARRAY<STRUCT<file_index: INT, ts: STRING, field: STRING, value: STRING>>, final_pages: ARRAY<STRUCT<page_no: INT, text: STRING>>, settings: ARRAY<STRUCT<key: STRING, value: STRING, ts: STRING>>"
)


class Workbench:
    """Jobs, their files and results in a folder of snapshots."""

    def __init__(self, spark: SparkSession, folder: str, client: N.ModelClient):
        self.spark, self.folder, self.client = spark, folder.rstrip("/"), client
        ship(spark)
        jobzip.register(spark)

    # -- state

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))

    def read(self, name: str) -> DataFrame:
        """The latest whole version of a table; an empty one before the first."""
        if not self._versions(name):
            return self.spark.createDataFrame([], EXTRA.get(name) or getattr(schema, name.upper()))
        return D.latest_snapshot(self.spark, f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        D.save_snapshot(df, f"{self.folder}/{name}", (self._versions(name) or [0])[-1] + 1)

    def log(self, msg: str, level: str = "INFO") -> None:
        row = self.spark.createDataFrame([(datetime.now(timezone.utc).replace(tzinfo=None), level, msg)], schema.LOGS)
        self.write("logs", self.read("logs").unionByName(row))

    # -- jobs

    def submit(self, files: DataFrame, settings: dict, file_polygons: DataFrame | None = None, name: str | None = None) -> str:
        """A new queued job of (filename, content) files; its id is unique by construction."""
        job_id = f"job_{int(datetime.now(timezone.utc).timestamp())}_{uuid.uuid4().hex[:8]}"
        s = {"model_version": None, "prompt": "", "confidence_threshold": None, "polygons": []} | settings
        job = self.spark.createDataFrame([(job_id, name, "queued", 0, s["model_version"], s["prompt"], s["confidence_threshold"], s["polygons"])], schema.JOBS)
        self.write("jobs", self.read("jobs").unionByName(job))
        if file_polygons is not None:
            self.write("file_polygons", self.read("file_polygons").unionByName(file_polygons.withColumn("job_id", F.lit(job_id)).select(self.read("file_polygons").columns)))
        self.add_files(job_id, files)
        return job_id

    def list_jobs(self) -> DataFrame:
        return J.list_jobs(self.read("jobs"))

    def get_job(self, job_id: str) -> DataFrame:
        return J.require_job(self.read("jobs"), job_id)

    def delete_jobs(self, ids: list[str]) -> None:
        for i in ids:
            J.require_job(self.read("jobs"), i)
        doomed = self.spark.createDataFrame([(i,) for i in ids], "job_id string")
        for n in ("jobs", "results", "file_polygons", "edits", "final_pages", "settings", "files"):
            self.write(n, J.delete_jobs(self.read(n), doomed))

    def rename(self, job_id: str, name: str) -> None:
        self.get_job(job_id)
        self.write("jobs", J.rename(self.read("jobs"), self.spark.createDataFrame([(job_id, name)], "job_id string, name string")))

    def merge_settings(self, job_id: str, patch: dict) -> None:
        """Keeps any settings as text; the ones that jobs have as columns change there too."""
        self.get_job(job_id)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [(job_id, k, v if isinstance(v, str) else json.dumps(v), now) for k, v in patch.items()]
        self.write("settings", self.read("settings").unionByName(self.spark.createDataFrame(rows, EXTRA["settings"])))
        known = {k: v for k, v in patch.items() if k in ("model_version", "prompt", "confidence_threshold")}
        if known:
            self.write("jobs", self.read("jobs").withColumns({k: F.when(F.col("job_id") == job_id, F.lit(v)).otherwise(F.col(k)) for k, v in known.items()}))

    def settings(self, job_id: str) -> DataFrame:
        s = self.read("settings").where(F.col("job_id") == job_id)
        return J.merge_settings(s.limit(0).drop("ts"), s)

    # -- files and results

    def add_files(self, job_id: str, files: DataFrame) -> None:
        """Adds (filename, content) files; a file of a name that the job has takes its place, without a row of its own."""
        self.get_job(job_id)
        new = files.select(F.lit(job_id).alias("job_id"), "filename", "content").dropDuplicates(["filename"])
        old = self.read("files")
        fresh = new.select("job_id", "filename").join(old.select("job_id", "filename"), ["job_id", "filename"], "left_anti")
        self.write("results", J.add_files(self.read("results"), fresh))
        self.write("files", old.join(new.select("job_id", "filename"), ["job_id", "filename"], "left_anti").select(new.columns).unionByName(new))

    def remove_files(self, job_id: str, indexes: list[int]) -> None:
        doomed = self.spark.createDataFrame([(job_id, i) for i in indexes], "job_id string, file_index int")
        r = self.read("results")
        missing = doomed.join(r, ["job_id", "file_index"], "left_anti").first()
        if missing:
            raise J.NotFound(f"{job_id}/{missing.file_index}")
        at = J.remove_files(R.files_of(r), doomed).select("job_id", F.col("file_index").alias("new_index"), F.col("old_index").alias("file_index"))
        self.write("results", r.join(at, ["job_id", "file_index"]).withColumn("file_index", F.col("new_index")).drop("new_index").select(r.columns))

    def file_content(self, job_id: str, file_index: int) -> bytes:
        name = self.read("results").where((F.col("job_id") == job_id) & (F.col("file_index") == file_index)).select("filename").first()
        row = name and self.read("files").where((F.col("job_id") == job_id) & (F.col("filename") == name[0])).select("content").first()
        if not row:
            raise J.NotFound(f"{job_id}/{file_index}")
        return bytes(row[0])

    def _work(self, job_id: str, file_index: int, poly_idx: int) -> DataFrame:
        """The work of one region; ``NotFound`` if the file or the region doesn't exist."""
        one = (F.col("job_id") == job_id) & (F.col("file_index") == file_index)
        w = X.work_list(self.read("results").where(one), self.read("file_polygons"), self.read("jobs"), force=True).where(F.col("poly_idx") == poly_idx)
        if w.isEmpty():
            raise J.NotFound(f"{job_id}/{file_index}/{poly_idx}")
        return w.withColumn("reused", F.lit(False))

    def crop(self, job_id: str, file_index: int, poly_idx: int) -> bytes:
        """PNG of one region of a stored page, cut anew so that it always fits the region."""
        row = X.cuts(self._work(job_id, file_index, poly_idx), self.read("files")).first()
        if row is None or row.png is None:
            raise J.NotFound(f"{job_id}/{file_index}/{poly_idx}")
        return bytes(row.png)

    def _options(self) -> DataFrame:
        s = self.read("settings")
        return X.options_of(J.merge_settings(s.limit(0).drop("ts"), s))

    def run(self, job_id: str | None = None) -> None:
        """Extracts the files of all queued jobs that have no text yet, or all of one job's that aren't done by hand.

        What a run has extracted is committed as one version, so a run that fails or is
        repeated goes on where the last whole one ended. ``done`` is the user's mark and stays.
        """
        results, jobs = self.read("results"), self.read("jobs")
        queued = jobs.where("status = 'queued'").select("job_id").distinct()
        open_ = F.col("job_id") == job_id if job_id else F.length(F.coalesce("extracted_text", F.lit(""))) == 0
        todo = results.join(queued, "job_id", "left_semi").where(open_)
        inferred = f"{self.folder}/inferred/{uuid.uuid4().hex}"

        def once(df: DataFrame) -> DataFrame:
            df.write.parquet(inferred)
            return self.spark.read.parquet(inferred)

        new = X.run(todo, self.read("file_polygons"), jobs, self.client, self.read("files"), self._options(), materialise=once)
        new = new.select("job_id", "file_index", F.col("extracted_text").alias("new_text"), F.col("regions").alias("new_regions"))
        none = F.create_map().cast("map<string,string>")
        joined = results.join(new, ["job_id", "file_index"], "left").withColumns({
            "extracted_text": F.coalesce("new_text", "extracted_text"), "regions": F.when(F.col("new_text").isNotNull(), R.merge_regions(F.col("regions"), F.coalesce("new_regions", none))).otherwise(F.col("regions")),
        })
        self.write("results", joined.select(results.columns))
        status = J.derive_status(jobs, self.read("results")).select("job_id", F.col("status").alias("s"), F.when(F.col("n_files") > 0, (F.col("n_done") / F.col("n_files") * 100).cast("int")).otherwise(100).alias("p"))
        self.write("jobs", jobs.join(status, "job_id", "left").withColumns({"status": F.coalesce("s", "status"), "progress": F.coalesce("p", "progress")}).select(jobs.columns))
        self.log("run finished", "SUCCESS")

    def rerun(self, job_id: str, patch: dict | None = None) -> None:
        """Runs a job again but for the files that are done; nested and flat setting payloads are both taken."""
        if patch:
            self.merge_settings(job_id, patch.get("settings", patch))
        mine = F.col("job_id") == job_id
        self.get_job(job_id)
        self.write("jobs", self.read("jobs").withColumns({"status": F.when(mine, "queued").otherwise(F.col("status")), "progress": F.when(mine, 0).otherwise(F.col("progress"))}))
        self.run(job_id)

    def set_done(self, job_id: str, file_index: int, done: bool = True) -> None:
        """The user's mark that a file is done: reruns leave it alone."""
        r = self.read("results")
        one = (F.col("job_id") == job_id) & (F.col("file_index") == file_index)
        self.write("results", r.withColumn("done", F.when(one, F.lit(done)).otherwise(F.col("done"))))

    def set_polygons(self, job_id: str, filename: str, polygons: DataFrame) -> None:
        """Replaces a file's regions by (points, region_order, done) rows; none clears them, their order counts."""
        p = self.read("file_polygons")
        rest = p.where(~((F.col("job_id") == job_id) & (F.col("filename") == filename)))
        new = polygons.select(F.lit(job_id).alias("job_id"), F.lit(filename).alias("filename"), (F.row_number().over(Window.orderBy("region_order")) - 1).alias("poly_idx"), "points", "region_order", "done")
        self.write("file_polygons", rest.unionByName(new.select(p.columns)))

    def retry_region(self, job_id: str, file_index: int, poly_idx: int) -> str:
        """Asks the model again about one region's crop and appends its text to the file's."""
        w = self._work(job_id, file_index, poly_idx)
        asked = X.ask(w, self.read("files"), self.client, self._options()).first()
        order = asked.region_order if asked.region_order is not None else w.first().region_order
        one_row = self.spark.createDataFrame([(job_id, file_index, order, asked.text)], "job_id string, file_index int, region_order int, text string")
        r = self.read("results")
        self.write("results", X.retry_text(r, one_row).select(r.columns))
        return asked.text

    def apply_edits(self, edits: DataFrame) -> None:
        self.write("edits", self.read("edits").unionByName(edits))
        r = self.read("results")
        self.write("results", E.apply(r, edits).select(r.columns))

    def translate(self, requests: DataFrame) -> DataFrame:
        """(job_id, file_index, model, translation, ok, error) of (…, model, target_lang, tone) rows."""
        return N.translate(N.translation_prompts(requests, self.read("results")), self.client).drop("system", "user")

    def preprocess(self, images: DataFrame, dpi: int, strength: int = K.DEFAULT_STRENGTH) -> DataFrame:
        return I.preprocess(images, dpi, strength)

    # -- archives, models, logs

    def export_zip(self, job_id: str, folder: str) -> None:
        """One archive with everything the job has: its data as one JSON member, and its files, paths kept."""
        mine = lambda n: self.read(n).where(F.col("job_id") == job_id)
        self.get_job(job_id)
        job = mine("jobs").distinct().limit(1)
        for name, cols in ARCHIVED.items():
            rows = mine(name).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("string").alias(c) if c == "ts" else F.col(c) for c in cols]))).alias(name)) if name != "results" else mine(name).groupBy("job_id").agg(
                F.sort_array(F.collect_list(F.struct("file_index", F.to_json("regions").alias("regions"), "filename", "extracted_text", "translation", "done"))).alias(name))
            job = job.join(rows, "job_id", "left")
        data = F.to_json(F.create_map(F.col("job_id"), F.struct(F.col("job_id").alias("id"), *[c for c in job.columns if c != "job_id"])))
        rows = job.select("job_id", F.lit(jobzip.DATA).alias("member"), F.encode(data, "UTF-8").alias("content"))
        files = mine("files").select("job_id", F.col("filename").alias("member"), "content")
        rows.unionByName(files).repartition(1, "job_id").write.format("jobzip").mode("append").save(folder)

    def import_zip(self, path: str) -> list[str]:
        """Imports archives with all that they hold; ids in use get a suffix. Returns the new ids."""
        a = self.spark.read.format("jobzip").load(path).cache()
        ids = J.import_ids(a, self.read("jobs")).cache()
        data = a.where(F.col("member") == jobzip.DATA).select(F.explode(F.from_json(F.decode("content", "UTF-8"), f"MAP<STRING, STRUCT<{ARCHIVE}>>")).alias("job_id", "j")).join(ids, "job_id").select(F.col("new_id").alias("job_id"), "j")
        data = data.cache()
        column = {"status": F.coalesce("j.status", F.lit("queued")), "progress": F.coalesce("j.progress", F.lit(0))}
        jobs = self.read("jobs")
        self.write("jobs", jobs.unionByName(data.select("job_id", *[column.get(c, F.col(f"j.{c}")).alias(c) for c in jobs.columns if c != "job_id"])))
        for name in ARCHIVED:
            old = self.read(name)
            x = data.select("job_id", F.posexplode(f"j.{name}").alias("at", "x"))
            own = {"file_index": F.coalesce("x.file_index", "at"), "regions": F.coalesce(F.from_json("x.regions", "map<string,string>"), F.create_map().cast("map<string,string>"))} if name == "results" else {}
            types = dict(old.dtypes)
            self.write(name, old.unionByName(x.select("job_id", *[own.get(c, F.col(f"x.{c}")).cast(types[c]).alias(c) for c in old.columns if c != "job_id"])))
        files = a.where(F.col("member") != jobzip.DATA).join(ids, "job_id").select(F.col("new_id").alias("job_id"), F.col("member").alias("filename"), "content")
        self.write("files", self.read("files").unionByName(files))
        new = sorted(r[0] for r in ids.select("new_id").collect())
        for x in (data, ids, a):
            x.unpersist()
        return new

    def list_models(self) -> DataFrame:
        names = self.client.list_models()
        return M.labelled(self.spark.createDataFrame([(n,) for n in names], "name string"))

    def model_integrity(self) -> DataFrame:
        return M.integrity(self.spark, self.list_models().select("name"))

    def log_tail(self, n: int = K.LOG_KEEP) -> DataFrame:
        return J.log_tail(self.read("logs"), n)

    def status(self) -> dict:
        ready = getattr(self.client, "ready", lambda: True)()
        return {"status": "ready" if ready else "offline"}


__all__ = ["Workbench"]
