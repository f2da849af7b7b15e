"""Missing or wrong language labels and mixed texts (problem 2).

Method: nearest-centroid classification. A passage (sentence) is a normalised
TF-IDF vector of character n-grams; each language has several centroids from
spherical k-means over labelled passages; the nearest centroid by cosine names the
language, and a passage too far from all of them, or without a clear margin, is
rejected. Labels of the fitting rows may be wrong: after a first fit, rows nearer
to another language than their own are left out of the second.

Fitting uses seeds and a bounded sample of labelled ``documents``
(``langdata.SAMPLE_ROWS``); all texts of ``results`` are scored, in Arrow batches.

Cases: null, empty and blank texts, and texts that no centroid accepts, have no
language and give no rows; very long texts are scored whole; a tie between
languages goes to the first in ``langdata.LANGS``; repeated rows give one result; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import langdata

CLUSTERS = 8
MIN_COSINE = 0.05
#: Of the best cosine, by which the best language must lead.
MIN_MARGIN = 0.12
#: Of the best cosine, a lead below this is doubtful.
DOUBT = 0.25
#: Rare n-grams weigh at most this, those not seen in fitting 0.6 of it.
TOP_IDF = 4.0
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def grams(word: str) -> list[str]:
    """Character n-grams of a lower-case word: padded trigrams, or CJK characters and pairs."""
    if CJK.search(word):
        return list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
    p = f" {word} "
    out = [p[i : i + 3] for i in range(len(p) - 2)]
    return out + [p] if 2 <= len(word) <= 5 else out


class Encoder:
    """Words to n-gram numbers, kept per word; texts to sparse rows, whole batches at once."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.size = vocab, len(vocab) + 1
        self.seen: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        a = self.seen.get(w)
        if a is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            other = self.size - 1
            a = self.seen[w] = np.array([self.vocab.get(g, other) for g in grams(w)], np.int64)
        return a

    def rows(self, passages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, n-gram, count) of all passages, sorted by row and n-gram."""
        parts, length = [], np.zeros(len(passages), np.int64)
        for i, s in enumerate(passages):
            for w in C.WORD.findall(s.lower()):
                a = self.word(w)
                parts.append(a)
                length[i] += len(a)
        if not parts:
            z = np.zeros(0, np.int64)
            return z, z, z
        key = np.repeat(np.arange(len(passages)), length) * self.size + np.concatenate(parts)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        k = key[first]
        return k // self.size, k % self.size, np.diff(np.append(first, len(key)))


class Centroids:
    """Several TF-IDF centroids per language; cosine to each."""

    def __init__(self, labelled: list[tuple[str, str]], clusters: int = CLUSTERS, seed: int = 2):
        df: Counter = Counter()
        for _, s in labelled:
            df.update({g for w in set(C.WORD.findall(s.lower())) for g in grams(w)})
        vocab = {g: i for i, g in enumerate(sorted(df))}
        self.encoder = Encoder(vocab)
        self.idf = np.zeros(self.encoder.size, np.float32)
        for g, i in vocab.items():
            self.idf[i] = min(np.log((1 + len(labelled)) / (1 + df[g])) + 0.3, TOP_IDF)
        self.idf[-1] = 0.6 * TOP_IDF
        langs = np.array([k for k, _ in labelled])
        r, g, c = self.encoder.rows([s for _, s in labelled])
        keep = np.ones(len(labelled), bool)
        for _ in range(2):
            self._fit(langs, r, g, c, keep, clusters, seed)
            cos = self._cosines(len(labelled), r, g, c)
            best = cos.max(1)
            own = np.where(langs[:, None] == np.array(self.codes)[None, :], cos, -1).max(1)
            keep = own >= best - 0.01
        self.codes_at = np.array([langdata.LANGS.index(k) if k in langdata.LANGS else -1 for k in self.codes])

    def _fit(self, langs: np.ndarray, r: np.ndarray, g: np.ndarray, c: np.ndarray, keep: np.ndarray, clusters: int, seed: int) -> None:
        w = c * self.idf[g]
        norm = np.sqrt(np.bincount(r, w * w, len(langs))) + 1e-9
        w = w / norm[r]
        rnd, codes, cents = np.random.default_rng(seed), [], []
        for k in langdata.SEEDS:
            own = np.flatnonzero((langs == k) & keep)
            if not len(own):
                continue
            m = max(1, min(clusters, len(own) // 20))
            at = np.full(len(langs), -1)
            at[own] = rnd.integers(0, m, len(own))
            sel = np.isin(r, own)
            rs, gs, ws = r[sel], g[sel], w[sel]
            for _ in range(8):
                cent = np.zeros((m, self.encoder.size), np.float32)
                np.add.at(cent, (at[rs], gs), ws)
                cent /= np.linalg.norm(cent, axis=1, keepdims=True) + 1e-9
                dot = np.stack([np.bincount(rs, ws * cent[j, gs], len(langs)) for j in range(m)], 1)
                new = dot[own].argmax(1)
                if (new == at[own]).all():
                    break
                at[own] = new
            cents.append(cent[np.linalg.norm(cent, axis=1) > 0.5])
            codes += [k] * len(cents[-1])
        self.codes, self.cent = codes, np.ascontiguousarray(np.concatenate(cents).T)
        self.cent[-1] = 0

    def _cosines(self, n: int, r: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros((n, self.cent.shape[1]), np.float32)
        if not len(r):
            return out
        w = (c * self.idf[g]).astype(np.float32)
        start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for a in range(0, len(start), 4096):
            lo, hi = start[a], start[a + 4096] if a + 4096 < len(start) else len(r)
            out[r[start[a : a + 4096]]] = np.add.reduceat(self.cent[g[lo:hi]] * w[lo:hi, None], start[a : a + 4096] - lo, axis=0)
        norm = np.sqrt(np.bincount(r, w * w, n)) + 1e-9
        return out / norm[:, None].astype(np.float32)

    def classify(self, passages: list[str], margin: float = MIN_MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, confidence, next best language number) of each passage."""
        cos = self._cosines(len(passages), *self.encoder.rows(passages))
        per = np.full((len(passages), len(langdata.LANGS) + 1), -1.0, np.float32)
        for j, k in enumerate(self.codes_at):
            np.maximum(per[:, k], cos[:, j], out=per[:, k])
        top = per.argmax(1)
        best = per.max(1)
        per[np.arange(len(per)), top] = -1
        second = per.argmax(1)
        lead = best - np.maximum(per.max(1), 0)
        at = np.where((best >= MIN_COSINE) & (lead >= margin * best) & (top < len(langdata.LANGS)), top, -1)
        return at, np.clip(lead / np.maximum(best, 1e-6), 0, 1), second


#: A hyphen at a line's end between letters; the sign comes first, so that a search can skip to it.
LINE_HYPHEN = re.compile(r"[-¬‐­](?<=[^\W\d_].)\s*\n\s*(?=[a-zß-ÿ])")
SPACED_OUT = re.compile(r"\W*(?:[^\W\d_] ){5,}")


def whole_sentences(text: str | None) -> list[str]:
    """Sentences of a text whose hyphenated lines are joined."""
    body = C.content(text)
    body = (LINE_HYPHEN.sub("", body) if "\n" in body else body).replace("­", "")
    out = []
    for p in C.PARA.split(body):
        out += [s for s in C.split_sentences(" ".join(p.split())) if s]
    return out


def weight(s: str, words: list[str] | None = None) -> int:
    """Letters of a passage; a CJK character counts as three, a spaced-out title nothing. ``words``: those of the passage, if known."""
    if SPACED_OUT.match(s):
        return 0
    return sum(map(len, C.WORD.findall(s) if words is None else words)) + (2 * len(CJK.findall(s)) if not s.isascii() else 0)


def judged(model: Centroids, texts: list[str]) -> list[tuple[int, int, str, int, int, float]]:
    """(text, sentence number, sentence, letters, language or -1, confidence) of all whole sentences, in order."""
    flat, owner, size, no = [], [], [], []
    for i, t in enumerate(texts):
        for m, s in enumerate(whole_sentences(t)):
            n = weight(s)
            if n >= 4:
                flat.append(s)
                owner.append(i)
                size.append(n)
                no.append(m + 1)
    at, conf, second = (v.tolist() for v in model.classify(flat))
    #: A doubtful passage whose next best is the text's clear main language is in that.
    clear: list[dict] = [{} for _ in texts]
    for i, n, k, q in zip(owner, size, at, conf):
        if k >= 0 and q >= DOUBT:
            clear[i][k] = clear[i].get(k, 0) + n
    main = [max(c, key=c.get) if c else -1 for c in clear]
    return [(i, m, s, n, main[i] if k >= 0 and q < DOUBT and o == main[i] else k, q) for i, m, s, n, k, q, o in zip(owner, no, flat, size, at, conf, second)]


def profile(model: Centroids, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
    """Per text: (language, whole sentences, letters, confidence), most letters first."""
    per: list[dict] = [{} for _ in texts]
    for i, _, s, n, k, q in judged(model, texts):
        if k >= 0:
            x = per[i].setdefault(k, [0, 0, 0.0])
            x[0] += n >= 18 and s[-1] in ".!?。！？\"»”)…"
            x[1] += n
            x[2] += n * q
    #: A text without any accepted passage is compared whole, without the margin.
    bare = [i for i, p in enumerate(per) if not p and weight(C.content(texts[i])) >= 12]
    if bare:
        at, conf, _ = model.classify([C.content(texts[i]) for i in bare], margin=0.0)
        for i, k, q in zip(bare, at.tolist(), conf.tolist()):
            if k >= 0:
                per[i][k] = [0, (n := weight(C.content(texts[i]))), n * q]
    return [sorted(((langdata.LANGS[k], x[0], x[1], x[2] / x[1]) for k, x in p.items()), key=lambda y: (-y[2], langdata.LANGS.index(y[0]))) for p in per]


def segments(model: Centroids, texts: list[str]) -> list[list[tuple[str, int, int, int, float]]]:
    """Per text: (language, first sentence, last sentence, letters, confidence) of its runs in one language, in order.

    Sentences that no language takes join the run before them, or the first run after.
    """
    out: list[list] = [[] for _ in texts]
    early: dict[int, int] = {}
    for i, m, _, n, k, q in judged(model, texts):
        runs = out[i]
        if k < 0:
            if runs:
                runs[-1][2] = m
            else:
                early.setdefault(i, m)
        elif runs and runs[-1][0] == k:
            runs[-1][2] = m
            runs[-1][3] += n
            runs[-1][4] += n * q
        else:
            runs.append([k, early.pop(i, m), m, n, n * q])
    return [[(langdata.LANGS[k], a, b, n, q / n) for k, a, b, n, q in runs] for runs in out]


SCHEMA = "job_id string, file_index int, fld string, lang string, n_sentences int, letters int, confidence double"


def passages(texts: DataFrame, documents: DataFrame, sample_rows: int = langdata.SAMPLE_ROWS) -> DataFrame:
    """(job_id, file_index, fld, passage, lang, first_sentence, last_sentence, letters, confidence) of ``fields`` rows."""
    model = texts.sparkSession.sparkContext.broadcast(Centroids(langdata.labelled_sample(documents, n=sample_rows)))
    names = ["job_id", "file_index", "fld", "passage", "lang", "first_sentence", "last_sentence", "letters", "confidence"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            for key, runs in zip(zip(part["job_id"], part["file_index"], part["fld"]), segments(model.value, list(part["text"]))):
                rows += [(*key, m + 1, k, f, l, n, round(float(q), 4)) for m, (k, f, l, n, q) in enumerate(runs)]
        return pd.DataFrame(rows, columns=names)

    return C.map_texts(texts, "job_id string, file_index int, fld string, passage int, lang string, first_sentence int, last_sentence int, letters int, confidence double", run)


def languages(texts: DataFrame, documents: DataFrame, sample_rows: int = langdata.SAMPLE_ROWS) -> DataFrame:
    """(job_id, file_index, fld, lang, n_sentences, letters, confidence) of ``fields`` rows."""
    model = texts.sparkSession.sparkContext.broadcast(Centroids(langdata.labelled_sample(documents, n=sample_rows)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            for key, langs in zip(zip(part["job_id"], part["file_index"], part["fld"]), profile(model.value, list(part["text"]))):
                rows += [(*key, k, int(n), int(m), float(q)) for k, n, m, q in langs]
        return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "lang", "n_sentences", "letters", "confidence"])

    return C.map_texts(texts, SCHEMA, run)


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text: its languages as an array, most letters first."""
    p = languages(C.fields(C.table(spark, sf_dir, "results")), C.table(spark, sf_dir, "documents")).distinct()
    return p.groupBy("job_id", "file_index", "fld").agg(F.array_sort(F.collect_set(F.struct((-F.col("letters")).alias("order"), "lang", "n_sentences", "letters", "confidence"))).alias("langs"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _profiles(spark, sf_dir)
    labels = C.table(spark, sf_dir, "lang_labels").select("job_id", F.col("file_index").cast("int").alias("file_index"), "fld", langdata.label_column(F.col("lang")).alias("code")).distinct()
    x = labels.join(p, ["job_id", "file_index", "fld"]).withColumn("main", F.expr("langs[0].lang"))
    key = ["job_id", "file_index", "fld"]
    #: All issues of a text in one array, so that the texts are scored once.
    row = lambda issue, lang: F.struct(F.lit(issue).alias("issue"), lang.alias("lang"))
    label = F.array(F.when(F.col("code").isNull(), row("missing", F.col("main"))).when(F.col("code") != F.col("main"), row("wrong", F.col("main"))))
    many = F.filter("langs", lambda y: y["n_sentences"] >= 2)
    mixed = F.when(F.size(many) >= 2, F.transform(many, lambda y: row("mixed", y["lang"]))).otherwise(F.array().cast("array<struct<issue:string,lang:string>>"))
    return x.select(*key, F.explode(F.array_compact(F.concat(label, mixed))).alias("i")).select(*key, "i.issue", "i.lang").distinct()


def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's languages: share of letters and confidence per language."""
    p = _profiles(spark, sf_dir).withColumn("total", F.expr("aggregate(langs.letters, 0, (a, x) -> a + x)"))
    return p.select("job_id", "file_index", "fld", "total", F.posexplode("langs").alias("rank", "x")).select(
        "job_id", "file_index", "fld", (F.col("rank") + 1).alias("rank"), "x.lang", "x.n_sentences", F.round(F.col("x.letters") / F.col("total"), 4).alias("share"), F.round("x.confidence", 4).alias("confidence")
    )


def text_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage of a text in one language, with its sentences (numbered from 1) and confidence."""
    return passages(C.fields(C.table(spark, sf_dir, "results")), C.table(spark, sf_dir, "documents")).distinct()


QUERIES = {"p2_passages": text_passages, "p2_found": found, "p2_languages": text_languages}
