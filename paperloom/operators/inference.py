"""Model calls as Arrow batches over an injected client."""

from __future__ import annotations

import hashlib
import json
import urllib.request
import zlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import scalars as S


class ModelClient(Protocol):
    """What a model server must offer; a client must be picklable."""

    def extract(self, model: str, prompt: str, image: bytes | None, options: dict) -> str: ...

    def translate(self, model: str, system: str, user: str) -> str: ...

    def list_models(self) -> list[str]: ...


class StubClient:
    """Deterministic client for tests: texts from checksums, failures by rule."""

    def __init__(self, fail_every: int = 0):
        self.fail_every = fail_every

    def extract(self, model: str, prompt: str, image: bytes | None, options: dict) -> str:
        n = zlib.crc32((prompt or "").encode() + (image or b"") + json.dumps(options, sort_keys=True, default=str).encode())
        if self.fail_every and n % self.fail_every == 0:
            raise RuntimeError(f"status {500 + n % 4} for chat call")
        return f"text {n:08x}"

    def translate(self, model: str, system: str, user: str) -> str:
        n = zlib.crc32(user.encode())
        if self.fail_every and n % self.fail_every == 0:
            raise RuntimeError("read timed out")
        return f" translated {n:08x} "

    def list_models(self) -> list[str]:
        return ["stub:latest"]


class EchoClient:
    """Deterministic client that says what it was sent: the picture's size and digests of prompt and options."""

    def __init__(self, fail_on: int = 0):
        self.fail_on = fail_on

    def extract(self, model: str, prompt: str, image: bytes | None, options: dict) -> str:
        w, h = int.from_bytes(image[16:20], "big"), int.from_bytes(image[20:24], "big")  # of the PNG's head
        if self.fail_on and (w * h) % self.fail_on == 0:
            raise RuntimeError(f"status {500 + w % 4} for chat call")
        said = "|".join([prompt, *(f"{k}={options[k]}" for k in sorted(options))])
        return f"{w}x{h} {hashlib.md5(said.encode()).hexdigest()}"

    def translate(self, model: str, system: str, user: str) -> str:
        d = hashlib.md5((system + user).encode()).hexdigest()
        if self.fail_on and d[0] == "0":
            raise RuntimeError("read timed out")
        return f" {d} "

    def list_models(self) -> list[str]:
        return ["echo:latest"]


class HttpClient:
    """Client of a chat server over HTTP, with the usual time limits."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def _post(self, path: str, body: dict, timeout: float) -> dict:
        req = urllib.request.Request(self.base + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.loads(r.read())

    def extract(self, model: str, prompt: str, image: bytes | None, options: dict) -> str:
        import base64

        o = K.DEFAULT_OPTIONS | {k: v for k, v in (options or {}).items() if v is not None}
        user = {"role": "user", "content": K.VISION_USER_LINE, "images": [base64.b64encode(image or b"").decode()]}
        body = {"model": model, "messages": [{"role": "system", "content": prompt or ""}, user], "stream": False}
        body["options"] = {"temperature": float(o["temp"]), "top_p": float(o["top_p"]), "num_predict": int(float(o["max_tokens"]))}
        return self._post("/api/chat", body, K.EXTRACT_TIMEOUT_S).get("message", {}).get("content", "")

    def translate(self, model: str, system: str, user: str) -> str:
        body = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False}
        return self._post("/api/chat", body, K.EXTRACT_TIMEOUT_S).get("message", {}).get("content", "").strip()

    def list_models(self) -> list[str]:
        try:
            with urllib.request.urlopen(self.base + "/api/tags", timeout=K.LIST_TIMEOUT_S) as r:
                return [m["name"] for m in json.loads(r.read()).get("models", [])]
        except (OSError, ValueError):
            return []

    def pull(self, model: str) -> dict:
        return self._post("/api/pull", {"name": model, "stream": False}, K.PULL_TIMEOUT_S)

    def ready(self) -> bool:
        try:
            urllib.request.urlopen(self.base + "/api/tags", timeout=K.STATUS_TIMEOUT_S).close()
            return True
        except OSError:
            return False


def _with(df: DataFrame, out: str) -> T.StructType:
    new = [T.StructField(out, T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())]
    return T.StructType([*df.schema.fields, *new])


def infer(work: DataFrame, client: ModelClient, image: str | None = None, calls: int | None = None, broken: str | None = None) -> DataFrame:
    """Adds (text, ok, error) to rows of (model, prompt, …[, image bytes, options]).

    A failure becomes the row's rendered error text; it never fails the task. ``calls``
    caps the calls in flight by the number of partitions. A row whose ``broken`` column
    says why its file can't be worked on gets the file's error text without a call. Materialise the result before
    using it twice: a second evaluation would call the model again.
    """
    if calls:
        work = work.repartition(calls)
    schema = _with(work.drop(*[c for c in (image, broken) if c]), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if broken and isinstance(row[broken], str):
                    out.append((K.FILE_ERROR.format(name=row["filename"], error=row[broken]), False, row[broken]))
                    continue
                try:
                    body = client.extract(row["model"], row["prompt"], bytes(row[image]) if image and row[image] is not None else None, dict(row.get("options") or {}))
                    out.append((K.EXTRACT_HEADER.format(model=row["model"]) + body, True, None))
                except Exception as e:  # noqa: BLE001 - any failure of a model is data
                    out.append((K.EXTRACT_ERROR.format(error=e), False, str(e)))
            yield pdf.drop(columns=[c for c in (image, broken) if c]).assign(text=[o[0] for o in out], ok=[o[1] for o in out], error=[o[2] for o in out])

    return work.mapInPandas(run, schema)


def translation_prompts(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(job_id, file_index, model, system, user): prompts as column expressions."""
    q = requests.select("job_id", "file_index", "model", "target_lang", F.coalesce("tone", F.lit(K.DEFAULT_TONE)).alias("tone")).distinct()
    r = results.groupBy("job_id", "file_index").agg(F.max("extracted_text").alias("body"))
    x = q.join(r, ["job_id", "file_index"])
    return x.select(
        "job_id", "file_index", "model", S.template(K.TRANSLATE_SYSTEM, target_lang=F.col("target_lang"), tone=F.col("tone")).alias("system"), S.template(K.TRANSLATE_USER, text=F.coalesce("body", F.lit(""))).alias("user")
    )


def translate(prompts: DataFrame, client: ModelClient, calls: int | None = None) -> DataFrame:
    """Adds (translation, ok, error) to ``translation_prompts`` rows."""
    if calls:
        prompts = prompts.repartition(calls)
    schema = _with(prompts, "translation")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, s, u in zip(pdf["model"], pdf["system"], pdf["user"]):
                try:
                    out.append((client.translate(m, s, u).strip(), True, None))
                except Exception as e:  # noqa: BLE001
                    out.append((K.TRANSLATE_ERROR.format(error=e), False, str(e)))
            yield pdf.assign(translation=[o[0] for o in out], ok=[o[1] for o in out], error=[o[2] for o in out])

    return prompts.mapInPandas(run, schema)
