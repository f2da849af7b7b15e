"""A job's whole life through the library's surface."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import schema
from paperloom.api import Workbench
from paperloom.operators.inference import StubClient
from paperloom.operators.images import encode_png
from paperloom.operators.jobs import NotFound

PAGE = encode_png(np.arange(600).reshape(20, 30) % 256)


def test_life_of_a_job(spark, tmp_path):
    w = Workbench(spark, str(tmp_path / "state"), StubClient())
    files = spark.createDataFrame([("a.png", PAGE), ("b.png", PAGE)], "filename string, content binary")
    square = [(0.1, 0.1), (0.5, 0.1), (0.5, 0.5), (0.1, 0.5)]
    polys = spark.createDataFrame([("", "a.png", 0, square, 3, None)], schema.FILE_POLYGONS)
    job = w.submit(files, {"model_version": "stub:latest", "prompt": "read"}, polys)
    assert w.list_jobs().first().name == job[-4:]
    w.run()
    r = {x.filename: x for x in w.read("results").collect()}
    assert r["a.png"].extracted_text.startswith("### REGION 3\n## Extracted by stub:latest") and set(r["a.png"].regions) == {"3"}
    assert r["b.png"].extracted_text.startswith("## Extracted by") and w.get_job(job).first().status == "completed"
    assert w.read("results").where("done").count() == 0
    w.set_done(job, 1)
    text_b = r["b.png"].extracted_text
    before = w.read("results").where("filename = 'a.png'").first().extracted_text
    w.add_files(job, spark.createDataFrame([("c.png", b"3"), ("a.png", PAGE)], "filename string, content binary"))
    assert w.read("results").count() == 3 and w.read("files").count() == 3
    w.rerun(job, {"settings": {"prompt": "again", "temp": 0.3}})
    assert w.read("results").where("filename = 'a.png'").first().extracted_text != before
    assert w.read("results").where("filename = 'b.png'").first().extracted_text == text_b
    assert w.read("results").where("filename = 'c.png'").first().extracted_text != ""
    assert {x.key: x.value for x in w.settings(job).collect()} == {"prompt": "again", "temp": "0.3"}
    text = w.retry_region(job, 0, 0)
    assert w.read("results").where("file_index = 0").first().extracted_text.endswith("### RETRIED REGION 3\n" + text)
    w.apply_edits(spark.createDataFrame([(job, 1, dt.datetime(2022, 1, 1), "text", "by hand")], schema.EDITS))
    assert w.read("results").where("file_index = 1").first().extracted_text == "by hand"
    q = spark.createDataFrame([(job, 1, "m", "German", None, None)], schema.TRANSLATION_REQUESTS)
    assert w.translate(q).first().ok
    assert w.file_content(job, 2) == b"3"
    assert w.crop(job, 0, 0)[:4] == b"\x89PNG"
    for bad in (lambda: w.crop(job, 9, 0), lambda: w.retry_region(job, 0, 7), lambda: w.remove_files(job, [44])):
        with pytest.raises(NotFound):
            bad()
    w.rename(job, "Box 7")
    w.export_zip(job, str(tmp_path / "out"))
    assert w.import_zip(str(tmp_path / "out")) == [job + "_1"]
    assert w.read("files").where(F.col("job_id") == job + "_1").count() == 3 and w.get_job(job + "_1").first().name == "Box 7"
    for t in ("results", "file_polygons", "edits", "settings"):
        own = lambda j: sorted(map(str, w.read(t).where(F.col("job_id") == j).drop("job_id").collect()))  # noqa: B023, E731
        assert own(job) == own(job + "_1") and own(job)
    poly = spark.createDataFrame([([(0.0, 0.0), (0.5, 0.5)], 2, None), ([(0.0, 0.0), (0.2, 0.2)], 1, True)], f"points {schema.POINTS}, region_order int, done boolean")
    w.set_polygons(job, "a.png", poly)
    assert [(x.poly_idx, x.region_order) for x in w.read("file_polygons").where(F.col("job_id") == job).orderBy("poly_idx").collect()] == [(0, 1), (1, 2)]
    w.set_polygons(job, "a.png", poly.limit(0))
    assert w.read("file_polygons").where(F.col("job_id") == job).count() == 0
    w.remove_files(job, [0])
    assert [x.filename for x in w.read("results").where(F.col("job_id") == job).orderBy("file_index").collect()] == ["b.png", "c.png"]
    w.delete_jobs([job])
    with pytest.raises(NotFound):
        w.get_job(job)
    with pytest.raises(NotFound):
        w.file_content(job, 0)
    assert w.status() == {"status": "ready"} and w.list_models().first().label == "STUB" and w.log_tail().count() >= 1
    assert w.model_integrity().where("ready").count() == 0
