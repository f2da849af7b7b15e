"""Repetition inside a single document (problem 5).

Method: a logistic regression over hashed word and character n-gram features,
probability-calibrated (Platt) and scored in Arrow batches, decides at the fixed
threshold ``CASE_P`` which texts repeat themselves. ``p5_share`` measures the repeated
content of every text exactly and gives the probability beside it.

Features of a text are the hashed n-grams of its normalised words: each n-gram
(runs of 1, 3 and ``RUN`` words; 12 characters) falls into one of ``DIM`` buckets of its kind,
repeated n-grams weigh their share of all n-grams of the kind; occurrences after the
first count in a second half of the buckets, their sum in a bucket of its own. Labels are the rows' exact shares,
over a bounded sample of ``SAMPLE_ROWS`` texts and copies of them into which
repeated parts were written; ``held_out`` gives recall and precision on a quarter of the
sample that took no part in the fit.

Cases: null, empty and blank texts have a share of 0 and are no cases; very long
texts are worked on whole in linear time; repeated rows give one result row;
an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .linear import fit_logistic, fit_platt, sigmoid

DIM = 128
KINDS = 4
SAMPLE_ROWS = 1500
CASE_P = 0.5
SHARE = 0.35
RUN = 6
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
SENT = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")


def words_of(text: str) -> list[str]:
    """Lower-case words without digits and punctuation; CJK characters stand alone."""
    ws = C.WORD.findall(text.lower())
    if not text.isascii() and CJK.search(text):
        ws = [x for w in ws for x in (w if CJK.search(w) else [w])]
    return ws


def repeated_share(text: str | None) -> float:
    """Share of the letters that lie in content that already stood earlier.

    Content: runs of six or more words, and whole lines, sentences and paragraphs
    of any length, with case, digits, punctuation and spacing ignored.
    """
    body = C.content(text)
    if not body.strip():
        return 0.0
    ws, units = [], set()
    for line in body.split("\n"):
        a = len(ws)
        for s in SENT.split(line):
            b = len(ws)
            ws += words_of(s)
            if len(ws) > b:
                units.add((b, len(ws)))
        if len(ws) > a:
            units.add((a, len(ws)))
    n = len(ws)
    if not n:
        return 0.0
    cover = np.zeros(n + 1, np.int32)
    seen: set = set()
    if n >= RUN:
        for i, g in enumerate(zip(*[ws[k:] for k in range(RUN)])):
            if g in seen:
                cover[i] += 1
                cover[min(n, i + RUN)] -= 1
            else:
                seen.add(g)
    short: set = set()
    for a, b in sorted(units):
        if b - a < RUN:
            k = tuple(ws[a:b])
            if k in short:
                cover[a] += 1
                cover[b] -= 1
            else:
                short.add(k)
    size = np.fromiter(map(len, ws), np.int64, n)
    return float(size[np.cumsum(cover[:n]) > 0].sum() / size.sum())


def features(text: str | None) -> tuple[list[int], list[float]]:
    """Bucket numbers and weights of a text; see the module's text."""
    ws = words_of(C.content(text))
    if not ws:
        return [], []
    flat = "".join(ws)
    at, val = [], []
    for k, grams in enumerate((ws, list(zip(ws, ws[1:], ws[2:])), list(zip(*[ws[i:] for i in range(RUN)])), [flat[i : i + 12] for i in range(0, len(flat) - 11, 3)])):
        total, extra = len(grams), len(grams) - len(set(grams))
        if not total:
            continue
        if extra * 20 > total:
            for g, n in Counter(grams).items():
                if n > 1:
                    h = zlib.crc32(g.encode() if isinstance(g, str) else " ".join(g).encode()) % DIM
                    at += (2 * k * DIM + h, (2 * k + 1) * DIM + h)
                    val += (1 / total, (n - 1) / total)
        at.append(KINDS * 2 * DIM + k)
        val.append(extra / total)
    return at, val


WIDTH = KINDS * 2 * DIM + KINDS


def dense(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), WIDTH), np.float32)
    for i, t in enumerate(texts):
        at, val = features(t)
        np.add.at(x[i], at, val)
    return x * 10


def written_repeats(texts: list[str], seed: int = 5) -> list[str]:
    """Copies of texts into which a phrase, line, sentence or paragraph is repeated."""
    rnd, out = random.Random(seed), []
    for t in texts:
        parts = [s for s in C.sentences(t) if len(s) > 15]
        if not parts:
            continue
        s = rnd.choice(parts)
        kind = rnd.randrange(4)
        if kind == 0:
            ws = s.split()
            s = " ".join(ws[: rnd.randint(2, 6)])
        elif kind == 1:
            s = " ".join(parts[: rnd.randint(1, 4)])
        sep = rnd.choice([" ", "\n", ", ", "\n\n"])
        out.append(t + sep + sep.join([s] * rnd.randint(1, 12)))
    return out


def _labelled(texts: list[str], seed: int) -> tuple[list[str], np.ndarray]:
    """The sample, its copies with written repetitions, and single sentences, with their labels."""
    texts = texts or ["a b c d e f g"]
    every = texts + written_repeats(texts, seed) + [""] * (1 + len(texts) // 20) + [s for t in texts for s in C.sentences(t)[:1]]
    y = np.array([repeated_share(t) >= SHARE for t in every], float)
    if y.min() == y.max():
        every, y = every + ["one two three four five six. " * 9, "a clean line"], np.append(y, [1.0, 0.0])
    return every, y


def fit(texts: list[str], seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of the calibrated model: probability = sigmoid(sum of weights + bias)."""
    every, y = _labelled(texts, seed)
    x = dense(every)
    held = np.arange(len(every)) % 4 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.ones(len(every), bool)
        w, b = fit_logistic(x, y)
    else:
        w, b = fit_logistic(x[~held], y[~held])
    a, c = fit_platt(x[held] @ w + b, y[held])
    return (w * a * 10).astype(np.float64), float(a * b + c)


def held_out(texts: list[str], seed: int = 5) -> tuple[float, float]:
    """(recall, precision) at ``CASE_P`` on every fourth text, with its copies, of a model of the others."""
    rest, part = [t for i, t in enumerate(texts) if i % 4], texts[::4]
    w, b = fit(rest, seed)
    every, y = _labelled(part, seed + 1)
    hit = sigmoid(dense(every) / 10 @ w + b) >= CASE_P
    both = float((hit & (y > 0)).sum())
    return both / max(1.0, y.sum()), both / max(1.0, float(hit.sum()))


def probabilities(results: DataFrame, sample_rows: int = SAMPLE_ROWS, exact: bool = False) -> DataFrame:
    """(job_id, file_index, p): calibrated probability of each text; with ``exact`` its share of repeated content too."""
    model = results.sparkSession.sparkContext.broadcast(fit(C.sample_texts(results, "extracted_text", sample_rows)))
    names = ["job_id", "file_index", "p", *(["share"] if exact else [])]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = model.value
        w = w.tolist()
        p = np.zeros(len(pdf))
        for i, t in enumerate(pdf["text"]):
            at, val = features(t)
            p[i] = b + sum(w[j] * v for j, v in zip(at, val))
        pdf = pdf.assign(p=sigmoid(p))
        return (pdf.assign(share=[repeated_share(t) for t in pdf["text"]]) if exact else pdf)[names]

    return C.map_texts(C.fields(results, ("extracted_text",)), "job_id string, file_index int, p double" + (", share double" if exact else ""), score)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(C.table(spark, sf_dir, "results")).where(F.col("p") >= CASE_P).select("job_id", "file_index").distinct()


def share_by_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, file_index, share, p): every result's exact share of repeated content.

    ``p`` is the model's probability of a case; a result without text has a share of 0
    and no probability.
    """
    r = C.table(spark, sf_dir, "results")
    keys = r.select("job_id", F.col("file_index").cast("int").alias("file_index")).distinct()
    s = probabilities(r, exact=True).groupBy("job_id", "file_index").agg(F.max(F.struct("share", "p")).alias("b"))
    s = s.select(F.col("job_id").alias("j"), F.col("file_index").alias("f"), "b.share", "b.p")
    own = F.col("job_id").eqNullSafe(F.col("j")) & F.col("file_index").eqNullSafe(F.col("f"))
    return keys.join(s, own, "left").select("job_id", "file_index", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), F.round("p", 6).alias("p"))


QUERIES = {"p5_found": found, "p5_share": share_by_result}
