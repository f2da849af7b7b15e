"""Shared pieces of the text operators: reading, line handling, samples, tokens.

Conventions used by every operator of this subpackage:

* a text column may be null, empty, blank or very long; it never raises;
* lines that begin with ``#`` belong to the workbench, not to the page;
* duplicate input rows lead to one output row (results are distinct on keys);
* only the needed columns are selected before any Python stage, so extra
  columns of any name pass by unseen.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
SENT_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])")
#: The first kind of ``SENT_END`` with the sign before it; a search can skip to the signs.
SPACED_END = re.compile(r"[.!?…][\"'»”’)\]]*\s+")
CJK_END = re.compile(r"[。！？]")
PARA = re.compile(r"\n[ \t\r\f\v\xa0]*\n+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HEADERS = re.compile(r"(?:#+ REGION \d+(?:\s+|$)|#+ Extracted by \S+ \(Ollama\)(?:\s+|$))+", re.I)


def content_lines(text: str | None) -> list[str]:
    """Lines of a text without the workbench's own ``#`` lines.

    Where line ends were flattened, page text may follow a header on its line; that
    text stays.
    """
    if not text:
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if "#" not in text:
        return lines
    out = []
    for x in lines:
        if not x.startswith("#"):
            out.append(x)
        elif (m := HEADERS.match(x)) and m.end() < len(x):
            out.append(x[m.end() :])
    return out


def content(text: str | None) -> str:
    """A text without the workbench's own ``#`` lines."""
    if text and "#" not in text and "\r" not in text:
        return text
    return "\n".join(content_lines(text))


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs with hard line ends turned into single spaces."""
    return [" ".join(p.split()) for p in PARA.split(content(text)) if p.strip()]


def split_sentences(passage: str) -> list[str]:
    """What ``SENT_END`` splits a passage into."""
    if not passage.isascii() and CJK_END.search(passage):
        return SENT_END.split(passage)
    out, last = [], 0
    for m in SPACED_END.finditer(passage):
        out.append(passage[last : m.start() + 1])
        last = m.end()
    return [*out, passage[last:]]


def sentences(text: str | None) -> list[str]:
    """Sentences over hard line ends; headings and list lines stay apart at blank lines."""
    out = []
    for p in paragraphs(text):
        out += [s for s in split_sentences(p) if s]
    return out


def fields(results: DataFrame, cols: tuple[str, ...] = ("extracted_text", "translation")) -> DataFrame:
    """(job_id, file_index, fld, text): one row per stored text, null texts left out."""
    one = lambda c: results.where(F.col(c).isNotNull()).select("job_id", F.col("file_index").cast("int").alias("file_index"), F.lit(c).alias("fld"), F.col(c).alias("text"))
    if len(cols) == 1:
        return one(cols[0])
    pairs = F.array(*[F.struct(F.lit(c).alias("fld"), F.col(c).alias("text")) for c in cols])
    return (
        results.select("job_id", F.col("file_index").cast("int").alias("file_index"), F.explode(pairs).alias("x"))
        .select("job_id", "file_index", "x.fld", "x.text")
        .where(F.col("text").isNotNull())
    )


def sample_rows(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """A bounded sample for fitting: at most n distinct rows, those of the least hashes.

    Hashes of the rows' own values choose, so neither the order of the files nor repeated
    rows matter; a share of the hashes that holds about 3 n rows is cut out before
    anything is sorted.
    """
    total, parts = df.count(), 1 << 20
    h = F.xxhash64(*by)
    if total > 3 * n:
        df = df.where(F.pmod(h, F.lit(parts)) < max(1, 3 * n * parts // total))
    return df.distinct().orderBy(F.pmod(h, F.lit(parts)), h, *by).limit(n)


def sample_texts(df: DataFrame, col: str, n: int) -> list[str]:
    """At most n distinct non-blank texts, drawn by hash; for fitting models only, never for corpus statistics."""
    rows = sample_rows(df.select(col).where(F.col(col).isNotNull() & (F.length(F.trim(F.col(col))) > 0)), [col], n).collect()
    return sorted(r[0] for r in rows)


#: Up to so many repeated texts their hashes are broadcast; beyond, the texts are shuffled.
BROADCAST_ROWS = 1_000_000


def once(df: DataFrame, col: str) -> DataFrame:
    """(col, one): the non-blank texts; ``one`` adds up to 1 over the rows of each distinct text."""
    texts = df.select(F.col(col).cast("string").alias(col)).where(F.length(F.trim(F.col(col))) > 0).withColumn("h", F.xxhash64(col))
    again = cut(texts.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"))
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return texts.join(again, "h", "left").select(col, F.coalesce(1 / F.col("times"), F.lit(1.0)).alias("one"))


def map_texts(df: DataFrame, schema: str, rows_of: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Arrow batches through a function of one frame; an empty batch gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield rows_of(pdf)

    return df.mapInPandas(run, schema)


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder that the session names; sets one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "paperloom-checkpoints")
        sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Materialises a small intermediate in the shared checkpoint folder, once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
