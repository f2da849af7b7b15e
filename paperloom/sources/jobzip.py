"""Job archives as a Spark data source: ``spark.read.format("jobzip")`` and the writer.

An archive holds ``job_data.json`` ({job_id: job}) and the job's files. Reading gives one
row per member; members with unsafe paths (absolute, or leading outside) are an error.
Writing takes rows of (job_id, member, content) and makes one archive per job in a task;
repartition by ``job_id`` first so that a job's rows meet.
"""

from __future__ import annotations

import glob
import io
import json
import os
import posixpath
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

DATA = "job_data.json"


class BadArchive(ValueError):
    """An archive without job data, with an empty one, or with unsafe paths."""


def safe_member(name: str) -> str:
    n = posixpath.normpath(name.replace("\\", "/"))
    if n.startswith(("/", "../")) or n == ".." or ":" in n.split("/")[0]:
        raise BadArchive(f"unsafe path in archive: {name}")
    return n


def read_archive(path: str) -> tuple[str, dict, list[str]]:
    """(job id, job, member names); the inner id follows the key."""
    with zipfile.ZipFile(path) as z:
        names = [safe_member(n) for n in z.namelist() if not n.endswith("/")]
        if DATA not in names:
            raise BadArchive(f"{path} has no {DATA}")
        data = json.loads(z.read(DATA))
    if not isinstance(data, dict) or not data:
        raise BadArchive(f"{path}: empty {DATA}")
    job_id, job = next(iter(data.items()))
    return job_id, job | {"id": job_id}, [n for n in names if n != DATA]


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.zip"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_Part(p) for p in found]

    def read(self, partition: _Part) -> Iterator[tuple]:
        job_id, job, names = read_archive(partition.path)
        yield (job_id, DATA, json.dumps({job_id: job}).encode())
        with zipfile.ZipFile(partition.path) as z:
            for n in names:
                yield (job_id, n, z.read(n))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        jobs: dict[str, list] = {}
        for r in rows:
            jobs.setdefault(r["job_id"], []).append((safe_member(r["member"]), bytes(r["content"] or b"")))
        for job_id, members in jobs.items():
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                for name, content in sorted(set(members)):
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
            at = os.path.join(self.path, safe_member(job_id) + ".zip")
            with open(f"{at}.tmp.{os.getpid()}", "wb") as f:
                f.write(buf.getvalue())
            os.replace(f"{at}.tmp.{os.getpid()}", at)
        return WriterCommitMessage()


class JobZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jobzip"

    def schema(self) -> str:
        return "job_id string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JobZip)
