"""Filling fixed-capacity containers with documents (problem 9).

Method: optimal length buckets. Documents are measured in tokens of a public
tokenizer; one longer than the capacity is split into full pieces and a rest, no other
is split. The global histogram of lengths (at most ``capacity`` entries) goes to the
driver, where dynamic programming over every length sets the boundaries of ``BUCKETS``
buckets so that padding each document to its bucket's upper bound costs least.
Token-budget batches form inside each bucket, from the longest bucket down: a batch of
the bucket up to ``u`` takes ``capacity // u`` of its documents, as many as fit however
they are padded. The room that a batch doesn't use (its padding and what ``u`` doesn't
divide) is the remainder; it is topped up with the longest documents that fit from the
buckets below, and from the batch's own bucket once those are used up. ``buckets`` reports the padding that
the boundaries leave, ``fill`` the room that is used in the end.

A batch is kept as a pattern ("k items of this length, so many times").
Documents take their places by rank within their length; ranks come from counts per
(length, salt), so a length that holds a third of all rows is spread over tasks. Only
the histogram and the patterns, both bounded by the capacity, are ever on the driver.

Cases: null and empty documents have 0 tokens and stand in container 0, needing no
room; capacities that are null or below 1 are ignored, repeated ones count once; ties
go by ``doc_id``; repeated documents are separate items; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .p8_encoding import PATTERN, TOKENIZER, TOKENIZER_DIR, load_ranks

BUCKETS = 16
#: Rows of one length that one task ranks at most, about.
RANK_ROWS = 1_000_000


def token_counts(documents: DataFrame, name: str = TOKENIZER, where: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = None
        for pdf in batches:
            if enc is None:
                import tiktoken

                enc = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=load_ranks(name, where), special_tokens={})
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_tokens int")


def bounds(hist: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most so many buckets that minimise the total padding.

    Exact over all lengths. A bucket over the lengths after i up to j pads
    ``len[j] * (count[j] - count[i]) - (sum[j] - sum[i])``: for each j the least of lines
    with the slope ``-count[i]``, which fall as i grows, so one hull a round is enough.
    """
    lens = sorted(n for n, k in hist.items() if n > 0 and k > 0)
    if not lens:
        return []
    m = len(lens)
    cnt, tot = [0], [0]
    for n in lens:
        cnt.append(cnt[-1] + hist[n])
        tot.append(tot[-1] + hist[n] * n)
    best: list[int | None] = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        new: list[int | None] = [None] * (m + 1)
        arg = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(1, m + 1):
            if best[j - 1] is not None:
                k, d = -cnt[j - 1], best[j - 1] + tot[j - 1]
                while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - k) >= (d - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append((k, d, j - 1))
            if not hull:
                continue
            x = lens[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            k, d, i = hull[at]
            new[j] = k * x + d + x * cnt[j] - tot[j]
            arg[j] = i
        back.append(arg)
        best = new
    out, j = [], m
    for arg in reversed(back):
        if j > 0:
            out.append(lens[j - 1])
            j = arg[j]
    return sorted(out)


def plan(hist: dict[int, int], capacity: int, upper: list[int] | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for every length: (length, first rank, ranks, first container, ranks per container).

    Also the number of containers. ``upper`` are the buckets' bounds, optimal ones if
    none are given. Patterns repeat as long as their lengths last.
    """
    have = {n: k for n, k in hist.items() if 0 < n <= capacity and k > 0}
    upper = bounds(have) if upper is None else upper
    alive = np.array(sorted(have), np.int64)
    left = np.array([have[n] for n in alive.tolist()], np.int64)
    used: dict[int, int] = dict.fromkeys(have, 0)
    places, containers = [], 0
    while len(alive):
        top = int(alive[-1])
        u = upper[int(np.searchsorted(upper, top))]
        b = int(np.searchsorted(upper, top))
        low = upper[b - 1] if b else 0
        own = int(np.searchsorted(alive, low, side="right"))
        pattern: dict[int, int] = {}
        room = capacity
        #: The batch: so many documents of the bucket as fit with their padding.
        need, i = capacity // u, len(alive) - 1
        while need and i >= own:
            k = min(need, int(left[i]))
            pattern[i] = k
            room -= k * int(alive[i])
            need -= k
            i -= 1
        #: The remainder: the buckets below, then what is left of the own one.
        for first, end in ((0, own), (own, len(alive))):
            while room > 0:
                i = min(end, int(np.searchsorted(alive, room, side="right"))) - 1
                while i >= first and left[i] <= pattern.get(i, 0):
                    i -= 1
                if i < first:
                    break
                k = min(room // int(alive[i]), int(left[i]) - pattern.get(i, 0))
                pattern[i] = pattern.get(i, 0) + k
                room -= k * int(alive[i])
        times = min(int(left[i]) // k for i, k in pattern.items())
        for i, k in pattern.items():
            n = int(alive[i])
            places.append((n, used[n], k * times, containers, k))
            used[n] += k * times
            left[i] -= k * times
        containers += times
        if any(left[i] == 0 for i in pattern):
            alive, left = alive[left > 0], left[left > 0]
    return places, containers


def pieces(counts: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity_tokens, doc_id, piece_no, first_token, n_tokens): what is to be placed."""
    caps = F.array(*[F.lit(c) for c in capacities])
    x = counts.select("doc_id", "n_tokens", F.explode(caps).alias("capacity_tokens"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int") - 1)
    return x.select("capacity_tokens", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no")).select(
        "capacity_tokens", "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity_tokens")).alias("first_token"), F.least(F.col("capacity_tokens"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity_tokens")).alias("n_tokens")
    )


def packed(documents: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity_tokens, container_id, doc_id, piece_no, first_token, n_tokens)."""
    spark = documents.sparkSession
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    schema = "capacity_tokens int, container_id long, doc_id long, piece_no int, first_token int, n_tokens int"
    if not capacities:
        return spark.createDataFrame([], schema)
    items = pieces(C.cut(token_counts(documents)), capacities)
    hist = {c: {} for c in capacities}
    for r in items.groupBy("capacity_tokens", "n_tokens").count().collect():  # at most capacity rows each
        hist[r[0]][r[1]] = r[2]
    table: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
    for c in capacities:
        rows: dict[int, list] = {}
        for n, first, ranks, box, per in plan(hist[c], c)[0]:
            rows.setdefault(n, []).append((first, box, per))
        for n, v in rows.items():
            table[c, n] = tuple(np.array(z, np.int64) for z in zip(*v))
    places = spark.sparkContext.broadcast(table)
    most = max([k for h in hist.values() for k in h.values()], default=1)
    salts = max(1, -(-most // RANK_ROWS))
    x = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)))
    by = ["capacity_tokens", "n_tokens"]
    offsets = x.groupBy(*by, "salt").count()
    offsets = offsets.withColumn("offset", F.sum("count").over(Window.partitionBy(*by).orderBy("salt")) - F.col("count")).drop("count")
    ranked = x.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("doc_id", "piece_no")) - 1)
    ranked = ranked.join(offsets, [*by, "salt"]).withColumn("rank", F.col("rank") + F.col("offset")).select("capacity_tokens", "doc_id", "piece_no", "first_token", "n_tokens", "rank")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box = np.zeros(len(pdf), np.int64)
            for (c, n), at in pdf.groupby(["capacity_tokens", "n_tokens"]).indices.items():
                if n > 0:
                    first, start, per = places.value[c, n]
                    r = pdf["rank"].to_numpy()[at]
                    k = np.searchsorted(first, r, side="right") - 1
                    box[at] = start[k] + (r - first[k]) // per[k]
            yield pdf.assign(container_id=box)[["capacity_tokens", "container_id", "doc_id", "piece_no", "first_token", "n_tokens"]]

    return ranked.mapInPandas(run, schema)


def _capacities(spark: SparkSession, sf_dir: str) -> list[int]:
    """The capacities of ``pack_sizes``, a table of fixed size."""
    return [r[0] for r in C.table(spark, sf_dir, "pack_sizes").select("capacity_tokens").distinct().collect() if r[0]]


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(C.table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_tokens, n_containers, n_tokens, used): share of the room that is used."""
    return (
        containers(spark, sf_dir).where("n_tokens > 0").groupBy("capacity_tokens")
        .agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("used", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))
    )


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_tokens, upper, n_items, n_tokens, padding): the buckets and what padding to their bounds costs."""
    items = pieces(C.cut(token_counts(C.table(spark, sf_dir, "documents"))), _capacities(spark, sf_dir) or [1])
    hist = [tuple(r) for r in items.where("n_tokens > 0").groupBy("capacity_tokens", "n_tokens").count().collect()]  # at most capacity rows each
    rows = []
    for c in sorted({r[0] for r in hist}):
        h = {n: k for cc, n, k in hist if cc == c}
        upper = bounds(h)
        for low, u in zip([0, *upper], upper):
            inside = {n: k for n, k in h.items() if low < n <= u}
            count, total = sum(inside.values()), sum(n * k for n, k in inside.items())
            rows.append((c, u, count, total, u * count - total))
    return spark.createDataFrame(rows, "capacity_tokens int, upper int, n_items long, n_tokens long, padding long")


QUERIES = {"p9_packed": containers, "p9_fill": fill, "p9_buckets": buckets}
