"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

Method: DuckDB recursive queries, one in-memory database per partition's batches.
Texts are split into pre-tokens by the tokenizer's published pattern; every distinct
pre-token becomes token-position rows (one per byte), which join the merge table and
contract each word's leftmost minimum-rank pair until no pair merges (fixpoint of a
recursive query); ordered aggregation turns the last positions into id lists, and each
text's ids are its pre-tokens' lists in order. A word's list is kept for later batches
of the same worker.

Ids are the ranks of the ``.tiktoken`` file (the same vocabulary as the JSON file);
no special tokens are produced: their strings are ordinary text.

Cases: a null and an empty text both have the empty list; very long texts are split by
the same pattern and encoded whole; a run of one kind of character of any length is
one pre-token and is contracted like any other;
repeated rows give repeated results only where ``doc_id`` repeats; an empty table gives
no rows; lone surrogates can't occur in Parquet strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TOKENIZER_DIR = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: The published pre-token pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept per worker; beyond it the store is emptied and filled anew.
KEPT_WORDS = 300_000
#: New words of one recursive query; a longer list is worked on in parts.
QUERY_WORDS = 4000

#: Contract each word's leftmost pair of least rank, all words at once, until nothing
#: changes. Further places of the same rank that don't overlap the ones before them go
#: in the same round: a new token's own pairs always have a higher rank, so the result
#: is that of one pair at a time, in rounds by distinct ranks instead of by pairs.
#: ``steps`` holds (word, position, token); only words with a pair left go on.
FIXPOINT = """
WITH RECURSIVE steps(w, p, tok, live) AS (
    SELECT w, p, tok, true FROM bytes
    UNION ALL
    SELECT * FROM (
        WITH cur AS (SELECT w, p, tok, lead(tok) OVER o AS nxt, lead(p) OVER o AS np, row_number() OVER o AS i FROM steps WHERE live WINDOW o AS (PARTITION BY w ORDER BY p)),
        cand AS (SELECT c.w, c.p, c.np, c.i, m.out, m.rank, min(m.rank) OVER (PARTITION BY c.w) AS least FROM cur c JOIN merges m ON m.a = c.tok AND m.b = c.nxt),
        occ AS (SELECT w, p, np, i, out, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM cand WHERE rank = least),
        sel AS (SELECT w, p, np, out, row_number() OVER (PARTITION BY w, run ORDER BY i) AS k FROM occ),
        pick AS (SELECT * FROM sel WHERE k % 2 = 1),
        words AS (SELECT DISTINCT w FROM pick)
        SELECT c.w, c.p, coalesce(k.out, c.tok), d.w IS NOT NULL
        FROM cur c LEFT JOIN pick k ON k.w = c.w AND k.p = c.p LEFT JOIN words d ON d.w = c.w
        WHERE NOT EXISTS (SELECT 1 FROM pick g WHERE g.w = c.w AND g.np = c.p)
    )
)
SELECT w, list(tok ORDER BY p) AS ids FROM steps WHERE NOT live GROUP BY w
"""


def load_ranks(name: str = TOKENIZER, where: str = TOKENIZER_DIR) -> dict[bytes, int]:
    with open(f"{where}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, out, rank): every way a token splits into two tokens merges at its rank."""
    a, b, out = [], [], []
    for tok, r in ranks.items():
        for i in range(1, len(tok)):
            x, y = ranks.get(tok[:i]), ranks.get(tok[i:])
            if x is not None and y is not None:
                a.append(x)
                b.append(y)
                out.append(r)
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "out": pa.array(out, pa.int32()), "rank": pa.array(out, pa.int64())})


class Encoder:
    """One worker's database and its store of encoded words."""

    def __init__(self, name: str = TOKENIZER, where: str = TOKENIZER_DIR):
        import duckdb
        import regex

        self.ranks = load_ranks(name, where)
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.con.register("m", merge_table(self.ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.con.unregister("m")
        self.kept: dict[str, np.ndarray] = {}

    def _fill(self, words: list[str]) -> None:
        """Encodes new words by the recursive query."""
        todo = []
        for w in words:
            r = self.ranks.get(w.encode())
            if r is not None:
                self.kept[w] = np.array([r], np.int32)
            else:
                todo.append(w)
        todo.sort(key=len)
        for a in range(0, len(todo), QUERY_WORDS):
            part = [w.encode() for w in todo[a : a + QUERY_WORDS]]
            size = np.array([len(w) for w in part])
            flat = np.frombuffer(b"".join(part), np.uint8)
            start = np.repeat(np.cumsum(size) - size, size)
            rows = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), size), "p": (np.arange(len(flat)) - start).astype(np.int32), "tok": np.array(self.single, np.int32)[flat]})
            self.con.register("bytes", rows)
            got = self.con.execute(FIXPOINT).fetchnumpy()
            self.con.unregister("bytes")
            for w, ids in zip(got["w"].tolist(), got["ids"]):
                self.kept[todo[a + w]] = np.asarray(ids, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = {w for p in pieces for w in p}.difference(self.kept)
        if new:
            self._fill(list(new))
        none = np.zeros(0, np.int32)
        return [np.concatenate([self.kept[w] for w in p]) if p else none for p in pieces]


def encoded(documents: DataFrame, name: str = TOKENIZER, where: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids) of every row; ``ids`` is never null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in batches:
            enc = enc or Encoder(name, where)
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": enc.encode([t if isinstance(t, str) else None for t in part["text"]])})

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(C.table(spark, sf_dir, "documents"))


QUERIES = {"p8_ids": ids}
