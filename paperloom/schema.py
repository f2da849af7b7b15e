"""Logical tables as Spark DDL."""

POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
POLYGON = f"STRUCT<points: {POINTS}, region_order: INT, done: BOOLEAN>"
JOBS = f"job_id STRING, name STRING, status STRING, progress INT, model_version STRING, prompt STRING, confidence_threshold DOUBLE, polygons ARRAY<{POLYGON}>"
RESULTS = "job_id STRING, file_index INT, filename STRING, regions MAP<STRING, STRING>, extracted_text STRING, translation STRING, done BOOLEAN"
FILE_POLYGONS = f"job_id STRING, filename STRING, poly_idx INT, points {POINTS}, region_order INT, done BOOLEAN"
EDITS = "job_id STRING, file_index INT, ts TIMESTAMP, field STRING, value STRING"
LOGS = "ts TIMESTAMP, level STRING, msg STRING"
FINAL_PAGES = "job_id STRING, page_no INT, text STRING"
MODELS = "name STRING"
TRANSLATION_REQUESTS = "job_id STRING, file_index INT, model STRING, target_lang STRING, tone STRING, requested_at TIMESTAMP"
