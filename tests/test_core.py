"""The document pipeline's operators on hand-made cases."""

import datetime as dt
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom import schema
from paperloom.functions import scalars as S
from paperloom.operators import edits as E
from paperloom.operators import images as I
from paperloom.operators import inference as N
from paperloom.operators import jobs as J
from paperloom.operators import models as M
from paperloom.operators import numbering
from paperloom.operators import pages as P
from paperloom.operators import regions as R
from paperloom.plans import extract as X
from paperloom.sinks import documents as D

SQUARE = [(0.1, 0.1), (0.5, 0.1), (0.5, 0.5), (0.1, 0.5)]


def results(spark, *rows):
    base = dict(job_id="j", file_index=0, filename="a.png", regions={}, extracted_text="", translation="", done=False)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.RESULTS)


def polygons(spark, *rows):
    base = dict(job_id="j", filename="a.png", poly_idx=0, points=SQUARE, region_order=1, done=None)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.FILE_POLYGONS)


def jobs(spark, *rows):
    base = dict(job_id="j", name=None, status="queued", progress=0, model_version="m", prompt="p", confidence_threshold=0.5, polygons=[])
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema.JOBS)


def test_polygons_fall_back_when_missing_or_empty(spark):
    r = results(spark, {}, {"file_index": 1, "filename": "b.png"}, {"file_index": 1, "filename": "b.png"})
    j = jobs(spark, {"polygons": [(SQUARE, 7, None)]})
    got = {x.file_index: (x.origin, len(x.polygons)) for x in R.resolve_polygons(r, polygons(spark, {}), j).collect()}
    assert got == {0: ("file", 1), 1: ("job", 1)}
    none = R.resolve_polygons(r, polygons(spark), jobs(spark, {})).collect()
    assert [x.origin for x in none] == ["whole", "whole"] and all(x.polygons == [] for x in none)
    assert R.explode_regions(R.resolve_polygons(r, polygons(spark), jobs(spark, {}))).where("poly_idx IS NULL").count() == 2


def test_boxes_are_clamped_and_empty_ones_dropped(spark):
    r = results(spark, {})
    p = polygons(spark, {"points": [(-0.5, 0.5), (0.5, 1.5)]}, {"poly_idx": 1, "points": [(1.1, 0.1), (1.4, 0.4)]}, {"poly_idx": 2, "points": [(0.3, 0.3)]})
    x = R.explode_regions(R.resolve_polygons(r, p, jobs(spark, {})))
    b = R.boxes(x, F.lit(100), F.lit(200)).select("poly_idx", "box.*").collect()
    assert [tuple(v) for v in b] == [(0, 0.0, 100.0, 50.0, 200.0)]


def test_equal_orders_all_appear_in_text_and_last_wins_in_map(spark):
    t = spark.createDataFrame([("j", 0, 0, 1, "a"), ("j", 0, 1, 1, "b"), ("j", 0, 2, 2, "c")], "job_id string, file_index int, poly_idx int, region_order int, text string")
    assert R.assemble(t).first().extracted_text == "### REGION 1\na\n\n### REGION 1\nb\n\n### REGION 2\nc\n\n"
    assert {(x.region_order, x.text) for x in R.regions_map(t).collect()} == {(1, "b"), (2, "c")}


def test_progress_truncates(spark):
    r = results(spark, *[{"file_index": i} for i in range(100)])
    p = {x.file_index: x.progress for x in R.progress(r).collect()}
    assert p[28] == 28 and p[99] == 100


def test_done_regions_with_text_are_reused(spark):
    r = results(spark, {"regions": {"1": "old"}})
    p = polygons(spark, {"done": True}, {"poly_idx": 1, "region_order": 2, "done": True})
    w = R.needs_model(R.explode_regions(R.resolve_polygons(r, p, jobs(spark, {}))), r)
    assert {(x.region_order, x.reused) for x in w.collect()} == {(1, True), (2, False)}


def test_merge_keeps_stale_keys_unless_pruned(spark):
    x = spark.range(1).select(F.create_map(F.lit("1"), F.lit("a"), F.lit("9"), F.lit("z")).alias("o"), F.create_map(F.lit("1"), F.lit("b")).alias("n"))
    assert x.select(R.merge_regions(F.col("o"), F.col("n")).alias("m")).first().m == {"1": "b", "9": "z"}
    assert x.select(R.merge_regions(F.col("o"), F.col("n"), True).alias("m")).first().m == {"1": "b"}


def page(width, height, seed=0):
    return I.encode_png(np.random.default_rng(seed).integers(0, 256, (height, width, 3)))


def test_run_sends_crops_prompt_and_options_once_a_region(spark, tmp_path):
    calls = str(tmp_path / "calls")

    class Counting(N.EchoClient):
        def extract(self, model, prompt, image, options):
            with open(calls, "a") as f:
                f.write("x")
            if image[:4] != b"\x89PNG":
                raise RuntimeError("no picture")
            return super().extract(model, prompt, image, options)

    r = results(spark, {}, {"file_index": 1, "filename": "b.png"}, {"file_index": 2, "filename": "c.png", "done": True}, {"file_index": 3, "filename": "d.png"}, {"file_index": 4, "filename": "e.png", "regions": {"1": "kept"}}, {"file_index": 5, "filename": "f.png"}, {"file_index": 6, "filename": "g.png"})
    half = [(0.25, 0.1), (0.75, 0.1), (0.75, 0.6), (0.25, 0.6)]
    p = polygons(spark, {"points": half}, {"poly_idx": 1, "points": [(-1.0, 0.5), (0.5, 2.0)], "region_order": 2}, {"filename": "d.png", "points": [(0.2, 0.2)]}, {"filename": "e.png", "points": half}, {"filename": "f.png", "points": half})
    pages = spark.createDataFrame([("j", "a.png", page(40, 30)), ("j", "b.png", page(20, 10)), ("j", "d.png", page(8, 8)), ("j", "e.png", b"no picture"), ("j", "f.png", page(9, 9)[:90])], "job_id string, filename string, content binary")
    options = X.options_of(spark.createDataFrame([("j", "temp", "0.3"), ("j", "tone", "x")], "job_id string, key string, value string"))
    said = hashlib.md5(b"p|temp=0.3").hexdigest()
    got = {x.file_index: (x.extracted_text, x.regions) for x in X.run(r, p, jobs(spark, {}), Counting(), pages, options).collect()}
    head = "## Extracted by m (Ollama)\n\n"
    assert got[0][0] == f"### REGION 1\n{head}20x15 {said}\n\n### REGION 2\n{head}20x15 {said}\n\n"
    assert got[1][0] == f"{head}20x10 {said}" and 2 not in got and got[3][0] == ""
    assert got[4][0] == "[Error processing e.png: cannot identify image file]" and got[5][0].startswith("[Error processing f.png: ")
    assert got[6][0] == "[Error processing g.png: no file content]"
    assert os.path.getsize(calls) == 3  # two regions of a.png, the whole of b.png


def test_decoding(tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (I.decode(I.encode_png(a)) == a).all() and (I.decode(I.encode_png(a[..., 0])) == a[..., 0]).all()
    for bad in (None, b"", b"abc", I.encode_png(a)[:40]):
        with pytest.raises(ValueError):
            I.decode(bad)
    #: The filters that encoders use, written by hand: each row names its own.
    rows, out, above = [], b"", np.zeros(15, int)
    for y in range(5):
        row = a[y].reshape(-1).astype(int)
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        est = left + above - corner
        near = np.where((abs(est - left) <= abs(est - above)) & (abs(est - left) <= abs(est - corner)), left, np.where(abs(est - above) <= abs(est - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, near][y]
        out += bytes([y]) + bytes(((row - guess) % 256).astype(np.uint8))
        rows.append(row)
        above = row
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + b"0000"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")
    assert (I.decode(png) == a[:5]).all()


def test_names_in_turn(spark):
    def by_hand(names):
        taken, out = [], []
        for f in names:
            new, k = f, 1
            while new in taken:
                base, dot, end = f.rpartition(".")
                new, k = (f"{base}_{k}.{end}" if dot else f"{f}_{k}"), k + 1
            taken.append(new)
            out.append(new)
        return out

    rnd = random.Random(2)
    lists = [["a.png", "a.png", "a_1.png"], ["a_1.png", "a.png", "a.png"], ["x", "x", "x_1", "b.png", "b.png", "b_2.png"]] + [[rnd.choice(["a.png", "a_1.png", "a_1_1.png", "b.png", "c", "c_1"]) for _ in range(12)] for _ in range(6)]
    files = spark.createDataFrame([(f"j{n}", i, f) for n, names in enumerate(lists) for i, f in enumerate(names)], "job_id string, file_index int, filename string")
    got = {(x.job_id, x.file_index): x.staged for x in J.unique_names(files).collect()}
    for n, names in enumerate(lists):
        assert [got[f"j{n}", i] for i in range(len(names))] == by_hand(names)


def test_positions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BLOCK", 7)
    rows = [("hot", i * 3) for i in range(50)] + [("j", 5), ("j", 2), ("k", None), (None, 1)]
    df = spark.createDataFrame(rows, "job_id string, file_index int")
    got = {(x.job_id, x.file_index): (x.pos, x.n) for x in numbering.positions(df, "job_id", ["file_index"], numbering.number_block("file_index"), total="n").collect()}
    assert all(got["hot", i * 3] == (i + 1, 50) for i in range(50)) and got["j", 2] == (1, 2) and got["j", 5] == (2, 2) and got["k", None] == (1, 1) and got[None, 1] == (1, 1)


def test_region_edits_replace_the_map(spark):
    r = results(spark, {"regions": {"1": "a", "2": "b"}}, {"file_index": 1, "regions": {"1": "z"}})
    e = spark.createDataFrame([("j", 0, dt.datetime(2022, 1, 1), "regions", '{"1": "new", "3": "c"}'), ("j", 1, dt.datetime(2022, 1, 1), "regions", "no json")], schema.EDITS)
    got = {x.file_index: x.regions for x in E.apply(r, e).collect()}
    assert got == {0: {"1": "new", "3": "c"}, 1: {"1": "z"}}


def test_log_tail_keeps_fifty(spark):
    t0 = dt.datetime(2022, 1, 1)
    logs = spark.createDataFrame([(t0 + dt.timedelta(seconds=i), None if i % 2 else "warn", f"m{i}") for i in range(51)] * 2, schema.LOGS)
    got = J.log_tail(logs).collect()
    assert len(got) == 50 and got[0].msg == "m1" and got[0].level == "INFO" and got[-1].time == "00:00:50"


def test_edits_take_the_latest_by_their_own_time(spark):
    t = dt.datetime(2022, 1, 1)
    e = spark.createDataFrame([("j", 0, t + dt.timedelta(days=1), "text", "new"), ("j", 0, t, "extracted_text", "late"), ("j", 0, t + dt.timedelta(days=2), "text", None), ("j", 0, t, "translation", "")], schema.EDITS)
    r = E.apply(results(spark, {"extracted_text": "old", "translation": "x"}), e).first()
    assert (r.extracted_text, r.translation) == ("new", "")


def test_job_snapshots(spark):
    r = results(spark, {}, {"file_index": 1, "filename": "a.png"}, {"file_index": 2, "filename": "b.png"})
    assert [(x.file_index, x.old_index) for x in J.remove_files(R.files_of(r), r.where("file_index = 1")).orderBy("file_index").collect()] == [(0, 0), (1, 2)]
    added = J.add_files(r, spark.createDataFrame([("j", "c.png"), ("k", "d.png")], "job_id string, filename string"))
    assert {(x.job_id, x.file_index, x.filename) for x in added.collect()} >= {("j", 3, "c.png"), ("k", 0, "d.png")}
    assert {x.staged for x in J.unique_names(R.files_of(r)).collect()} == {"a.png", "a_1.png", "b.png"}
    j = jobs(spark, {}, {"job_id": "j_1"}, {"job_id": "k"})
    assert {(x.job_id, x.new_id) for x in J.import_ids(j, j).collect()} == {("j", "j_2"), ("j_1", "j_1_1"), ("k", "k_1")}
    assert J.delete_jobs(r, j.where("job_id = 'j'")).count() == 0
    assert [x.id for x in J.list_jobs(j).collect()] == ["k", "j_1", "j"]
    with pytest.raises(J.NotFound):
        J.require_job(j, "none")
    names = spark.createDataFrame([("j", "  "), ("k", "new")], "job_id string, name string")
    assert {(x.job_id, x.name) for x in J.rename(j, names).collect()} == {("j", "j"), ("j_1", None), ("k", "new")}


def test_models(spark):
    m = spark.createDataFrame([("qwen2.5:7b",), ("x/german-ocr-3.1:latest",), ("other",)], "name string")
    assert {(x.id, x.ready) for x in M.integrity(spark, m).collect() if x.ready} == {("qwen2.5:32b", True)}
    assert M.parameters(spark, m).count() == 0 and M.parameters(spark, m, untagged=True).count() == 1
    assert {x.label: x.translates for x in M.labelled(m).collect()}["GERMAN-OCR-3.1"] is False


def test_pages(spark):
    p = spark.createDataFrame([("j", 1, "a\n\nb"), ("j", 1, "a\n\nb"), ("j", 2, None)], schema.FINAL_PAGES)
    assert P.lines(p).where("page_no = 1").count() == 3
    x = P.page_lists(p).select(P.insert_after(F.col("pages"), 2, "n").alias("i"), P.delete_at(F.col("pages"), 1).alias("d")).first()
    assert x.i == ["a\n\nb", "", "n"] and x.d == [""]
    y = spark.range(60).selectExpr("cast(id as int) AS line_no")
    assert {(r.sheet, r.y) for r in P.paginate(y).where("line_no IN (0, 53, 54)").collect()} == {(0, 20), (0, 285), (1, 20)}
    raw = spark.createDataFrame([("3a",), ("x",), ("99",), ("-1",), (None,)], "n string")
    assert [r.p for r in raw.select(S.page_choice(F.col("n"), F.lit(5)).alias("p")).collect()] == [3, 1, 5, 1, 1]


def test_page_sizes(spark):
    for dpi, want in ((150, (1240, 31)), (300, (2481, 63)), (600, (4962, 125))):
        r = I.plan_sizes(spark.createDataFrame([(3000, 2000)], "height int, width int"), dpi).first()
        assert (r.target, r.block) == want


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 255, (40, 30, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(I.encode_png(a))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    from paperloom.sources.tables import page_files, page_images

    img = page_images(spark, str(tmp_path))
    row = img.first()
    assert img.count() == 1 and (np.frombuffer(row.data, np.uint8).reshape(40, 30, 3)[..., ::-1] == a).all()
    out = I.preprocess(img, 150).first()
    assert out.error is None and out.png[:4] == b"\x89PNG"
    assert {x.filename for x in page_files(spark, str(tmp_path)).collect()} == {"a.png", "bad.png"}
    assert (I.resize(np.full((5, 4), 77, np.uint8), 9, 7) == 77).all()
    flat = I.local_threshold(np.full((20, 20), 9, np.uint8), 11, 2)
    assert (flat == 255).all()
    assert I.upright(a, 6).shape == (30, 40, 3) and I.exif_orientation(b"\xff\xd8 no") == 1


def test_exports(spark):
    r = results(spark, {"extracted_text": "x"}, {"file_index": 1, "filename": "b.png", "extracted_text": None})
    assert D.batch_text(r).first().body == "--- a.png ---\n\nx\n\n--- b.png ---\n\n\n\n"
    p = spark.createDataFrame([("j", ["a\n(b)", "c"]), ("k", [])], "job_id string, pages array<string>")
    for x in D.render_pages(p, "pdf").collect():
        assert x.content.startswith(b"%PDF") and x.content.endswith(b"%%EOF\n")
    import io
    import zipfile

    doc = next(x.content for x in D.render_pages(p, "docx").collect() if x.job_id == "j")
    assert zipfile.ZipFile(io.BytesIO(doc)).read("word/document.xml").count(b"nextPage") == 2


def test_job_archive_round_trip_and_errors(spark, tmp_path):
    from paperloom.sources import jobzip

    jobzip.register(spark)
    rows = [("job_1", "job_data.json", b'{"job_1": {"id": "old", "results": []}}'), ("job_1", "sub/a.png", b"1"), ("job_1", "a.png", b"2")]
    spark.createDataFrame(rows, "job_id string, member string, content binary").coalesce(1).write.format("jobzip").mode("append").save(str(tmp_path))
    got = {x.member: bytes(x.content) for x in spark.read.format("jobzip").load(str(tmp_path)).collect()}
    assert got["sub/a.png"] == b"1" and got["a.png"] == b"2" and b'"id": "job_1"' in got["job_data.json"]
    import zipfile

    for name, members in (("e.zip", {"job_data.json": "{}"}), ("n.zip", {"x": ""}), ("u.zip", {"../x": ""})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        with pytest.raises(jobzip.BadArchive):
            jobzip.read_archive(str(tmp_path / name))


def test_job_database(spark, tmp_path):
    from paperloom.sources.tables import job_database

    (tmp_path / "db.json").write_text('{"j": {"name": "n", "status": "queued", "progress": 3, "settings": {"a": "1"}, "results": [{"filename": "f", "regions": {"1": "t"}}]}}')
    x = job_database(spark, str(tmp_path / "db.json")).first()
    assert x.job_id == "j" and x.results[0].regions == {"1": "t"} and x.settings == {"a": "1"}
    assert job_database(spark, str(tmp_path / "none.json")).count() == 0


def test_empty_tables(spark):
    e = {n: spark.createDataFrame([], getattr(schema, n)) for n in ("RESULTS", "FILE_POLYGONS", "JOBS", "EDITS", "LOGS", "FINAL_PAGES")}
    assert R.resolve_polygons(e["RESULTS"], e["FILE_POLYGONS"], e["JOBS"]).count() == 0
    none = spark.createDataFrame([], "job_id string, filename string, content binary")
    assert X.run(e["RESULTS"], e["FILE_POLYGONS"], e["JOBS"], N.StubClient(), none).count() == 0
    assert E.apply(e["RESULTS"], e["EDITS"]).count() == 0 and J.log_tail(e["LOGS"]).count() == 0
    assert D.batch_text(e["RESULTS"]).count() == 0 and P.page_lists(e["FINAL_PAGES"]).count() == 0


def test_translation_errors_are_rows(spark):
    class Down(N.StubClient):
        def translate(self, model, system, user):
            raise OSError("connection refused")

    q = spark.createDataFrame([("j", 0, "m", "German", None, None)], schema.TRANSLATION_REQUESTS)
    p = N.translation_prompts(q, results(spark, {"extracted_text": "hi"}))
    assert "into German with a Professional tone" in p.first().system and p.first().user == "<source_document>\nhi\n</source_document>"
    assert N.translate(p, Down()).first().translation == "[Translation Error: connection refused]"
    assert N.translate(p, N.StubClient()).first().translation.startswith("translated")


def test_file_queue_stream(spark, tmp_path):
    from paperloom.streaming import ingest as T

    src = tmp_path / "in"
    src.mkdir()
    for n in ("a.png", "b.png", "db.json", "x_crop_0.png"):
        (src / n).write_bytes(b"x")
    seen = []
    q = T.run_queue(T.file_queue(spark, str(src)), lambda df, n: seen.extend(r.filename for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["a.png", "b.png"]


def test_stream_log_days_has_every_day(spark, tmp_path):
    from paperloom import queries as Q

    rows = "VALUES ('2022-05-01 10:00', 'info', 'a'), ('2022-05-06 09:00', null, 'b'), ('2022-05-06 09:00', 'INFO', 'b'), ('2022-05-07 01:24', 'error', 'c'), ('2022-04-01 00:00', 'INFO', 'late') AS t(ts, level, msg)"
    spark.sql(f"SELECT CAST(ts AS TIMESTAMP) AS ts, level, msg FROM {rows}").repartition(5).write.parquet(str(tmp_path / "logs.parquet"))
    got = {(r.start.strftime("%Y-%m-%d"), r.level, r.n) for r in Q.queries()["stream_log_days"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in Q.queries()["log_days"](spark, str(tmp_path)).collect()} and len(got) == 4


def test_snapshots(spark, tmp_path):
    D.save_snapshot(spark.range(1), str(tmp_path / "s"), 1)
    D.save_snapshot(spark.range(2), str(tmp_path / "s"), 2)
    assert D.latest_snapshot(spark, str(tmp_path / "s")).count() == 2
    assert Row(a=K.LOG_KEEP).a == 50
