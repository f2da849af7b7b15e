"""Abusive, hateful and sexually explicit content (problem 10).

Method: a support vector machine over a string kernel with Nyström landmarks. Words
are compared by a gap-weighted subsequence kernel (subsequences of two and three
letters, gaps decayed by ``DECAY``), so inserted, masked or doubled letters keep most
of the similarity; sentences by the sum of squared word similarities and of products
over neighbouring words, each word weighted by its rarity over all documents, so that
words which stand everywhere neither make a case nor hide one. Landmarks are the labelled sentences; a linear SVM (squared
hinge) per category is trained in the Nyström space. At scoring time the machine's
weights are folded onto words and word pairs, which are scored once and kept; a passage
counts by its best window of ``WINDOWS`` words or as a whole.

Labelled sentences are the templates of ``abuse_sentences``, written for it and found in
no test table. The machine then trains itself on a bounded sample of ``documents``
(``SAMPLE_ROWS``, drawn by hash): what a fit holds for clean, or what has no rare word,
becomes a clean row, what it is sure of a labelled one (``ROUNDS``).

Cases: null, empty and blank documents score -1 and give no rows; very long documents
are scored passage by passage over their whole length; a passage of one word is none; a
document may have several categories, one row each; repeated rows give one result; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .abuse_sentences import CATEGORIES, labelled

SAMPLE_ROWS = 3000
#: Filled sentences of each template that are landmarks.
LANDMARKS = 3
#: Weight of a case's slack over a clean sentence's.
POSITIVE = 2.0
DECAY = 0.6
SPAN = 5
DIM = 4096
#: A document is a case from this decision value on; unseen wordings score lower than labelled ones.
CASE = -0.4
#: A word has the full weight where fewer than 1 of 403 texts hold it, or fewer than ``OFTEN``.
TOP_WEIGHT = 6.0
#: Words of the windows that a passage is scored in, beside the whole.
WINDOWS = (8,)
#: Word similarities below this are nothing.
LEAST = 0.45
PASSAGE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n+|(?<=[。！？])|\\n")
WHOLE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n[ \t]*\n+|(?<=[。！？])")
TOKEN = re.compile(r"[^\W\d_]+(?:[*]+[^\W\d_]*)*|[*]+[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){3,}[^\W_](?![^\W_])")
INNER = re.compile(r"(?<=[^\W\d_])[0-9@$!|#+](?=[^\W\d_0-9@$*])|(?<![\w])[0-9@$](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[0-9@$](?![\w])|(?<=[^\W\d_])[0-9@$*]{2,3}(?=[^\W\d_])")
LEET = str.maketrans("0134578@$!|#+", "oieastbasiiht")
#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans("аеорсухіѕјһԁгтпмвкАВЕКМНОРСТХІЅЈ", "aeopcyxisjhdrtnmbkABEKMHOPCTXISJ")
ZERO = re.compile("[​‌‍⁠﻿­]")


def plain(text: str) -> str:
    """Undoes what hides words: zero-width marks, look-alike letters, spacing, digits, doubling."""
    if not text.isascii():
        text = ZERO.sub("", text)
        if re.search("[Ѐ-ӿ]", text):
            text = re.sub(r"[^\W\d_]+", lambda m: m.group(0).translate(ALIKE) if re.search("[A-Za-zÀ-ɏ]", m.group(0)) or len(m.group(0).translate(ALIKE).encode()) == len(m.group(0)) else m.group(0), text)
        text = unicodedata.normalize("NFKC", text)
    text = SPACED.sub(lambda m: m.group(0).replace(" ", ""), text)
    text = INNER.sub(lambda m: m.group(0).translate(LEET), text)
    return re.sub(r"([^\W\d_])\1{2,}", r"\1", text)


def tokens(sentence: str) -> list[str]:
    """Lower-case words without accents; masked letters are gaps."""
    s = sentence.lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return TOKEN.findall(s)


def subsequences(word: str) -> dict[int, float]:
    """Hashed weights of a word's letter subsequences of two and three letters."""
    out: dict[int, float] = {}
    w = f"^{word.replace('*', '')}$" if "*" not in word else f"^{word}$"
    n = len(w)
    keep = [i for i in range(n) if w[i] != "*"]
    for x, i in enumerate(keep):
        for y in range(x + 1, len(keep)):
            j = keep[y]
            if j - i >= SPAN:
                break
            h = (ord(w[i]) * 131 + ord(w[j]) * 31337) % DIM
            out[h] = out.get(h, 0.0) + 0.5 * DECAY ** (j - i - 1)
            for z in range(y + 1, len(keep)):
                k = keep[z]
                if k - i >= SPAN:
                    break
                h = (ord(w[i]) * 7919 + ord(w[j]) * 104729 + ord(w[k]) * 1299709) % DIM
                out[h] = out.get(h, 0.0) + DECAY ** (k - i - 2)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {h: v / norm for h, v in out.items()} if norm else {}


class Words:
    """The words of the landmarks; similarities of any word to them, kept per word."""

    def __init__(self, vocab: list[str], common: dict[str, float] | None = None):
        self.vocab, self.common = vocab, common or {}
        self.table = np.zeros((DIM, len(vocab)), np.float32)
        for j, w in enumerate(vocab):
            for h, v in subsequences(w).items():
                self.table[h, j] = v
        self.kept: dict[str, dict[int, float]] = {}

    def weight(self, w: str) -> float:
        """From 0 for a word of every document to 1 for a rare one."""
        return self.common.get(w, 1.0)

    def near(self, w: str) -> dict[int, float]:
        """Landmark words of at least ``LEAST`` similarity, with the squared similarity times the word's weight."""
        r = self.kept.get(w)
        if r is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            f = subsequences(w)
            if f:
                k = np.array(list(f.values()), np.float32) @ self.table[list(f)]
                at = np.flatnonzero(k >= LEAST)
                u = self.weight(w)
                r = {int(i): float(k[i]) ** 2 * u for i in at}
            else:
                r = {}
            self.kept[w] = r
        return r


class Machine:
    """The trained machine; ``scores`` gives a decision value per category."""

    def __init__(self, rows: list[tuple[str, str]], clean: dict[str, float], own: list[tuple[str, str]] | None = None, words: Words | None = None, common: dict[str, float] | None = None):
        marks = list(dict.fromkeys([*(t for _, t in labelled(LANDMARKS)), *(t for _, t in own or ())]))
        units = [tokens(t) for t in marks]
        rows = rows + (own or [])
        vocab = sorted({w for u in units for w in u})
        common = words.common if words is not None else common
        self.words = words if words is not None and words.vocab == vocab else Words(vocab, common)
        at = {w: i for i, w in enumerate(self.words.vocab)}
        m, v = len(marks), len(self.words.vocab)
        weight = [self.words.weight(w) for w in self.words.vocab]
        self.single = np.zeros((v, m), np.float32)
        pairs: dict[tuple[int, int], np.ndarray] = {}
        for l, u in enumerate(units):
            ids = [at[w] for w in u]
            for i in ids:
                self.single[i, l] += weight[i]
            for p in zip(ids, ids[1:]):
                pairs.setdefault(p, np.zeros(m, np.float32))[l] += weight[p[0]] * weight[p[1]]
        self.first: dict[int, list[tuple[int, int]]] = {}
        for n, (a, b) in enumerate(pairs):
            self.first.setdefault(a, []).append((b, n))
        self.double = np.stack(list(pairs.values()))
        self.fold: list | None = None
        texts = [t for _, t in rows] + list(clean)
        times = np.array([1.0] * len(rows) + list(clean.values()))
        y = np.zeros((len(texts), len(CATEGORIES)))
        for i, (c, _) in enumerate(rows):
            if c in CATEGORIES:
                y[i, CATEGORIES.index(c)] = 1
        k = np.stack([self._row(tokens(plain(t))) for t in texts])
        #: Nyström: features are the kernel to the landmarks, whitened by theirs.
        gram = np.stack([self._row(u) for u in units])
        val, vec = np.linalg.eigh((gram + gram.T) / 2)
        ok = val > 1e-3 * val.max()
        white = (vec[:, ok] / np.sqrt(val[ok])).astype(np.float32)
        x = k @ white
        beta, self.bias = [], []
        for j in range(len(CATEGORIES)):
            w, b = self._svm(x, np.where(y[:, j] > 0, 1.0, -1.0), np.where(y[:, j] > 0, POSITIVE, times))
            beta.append(white @ w)
            self.bias.append(b)
        beta = np.stack(beta, 1)
        self.word_score, self.pair_score = self.single @ beta, self.double @ beta
        self.bias = np.array(self.bias)
        self._forget()
        del self.single, self.double

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.word_rows = np.zeros((4096, len(CATEGORIES)))
        self.weights = np.zeros(4096)
        self.pair_ids: dict[int, int] = {}
        self.pair_rows = np.zeros((4096, len(CATEGORIES)))

    def _row(self, ws: list[str]) -> np.ndarray:
        out = np.zeros(self.single.shape[1], np.float32)
        near = [self.words.near(w) for w in ws]
        for r in near:
            for i, s in r.items():
                out += s * self.single[i]
        for a, b in zip(near, near[1:]):
            for i, s in a.items():
                for j, n in self.first.get(i, ()):
                    if j in b:
                        out += s * b[j] * self.double[n]
        return out / max(1.0, 2.0 * sum(map(self.words.weight, ws))) ** 0.5

    @staticmethod
    def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 160.0, steps: int = 160) -> tuple[np.ndarray, float]:
        """Squared-hinge linear SVM by accelerated gradient descent."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
        c = (c * weight / len(y) * 50).astype(np.float32)
        y = y.astype(np.float32)
        lip = 1 + 2.05 * float(np.linalg.eigvalsh((x.T * c) @ x)[-1])
        w = z = np.zeros(x.shape[1], np.float32)
        for t in range(steps):
            slack = np.maximum(0, 1 - y * (x @ z))
            g = np.append(z[:-1], np.float32(0)) - 2 * x.T @ (c * y * slack)
            new = (z - g / lip).astype(np.float32)
            z = new + np.float32(t / (t + 3)) * (new - w)
            w = new
        return w[:-1], float(w[-1])

    def _id(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            i = self.ids[w] = len(self.ids)
            self.names.append(w)
            if i >= len(self.word_rows):
                self.word_rows = np.concatenate([self.word_rows, np.zeros_like(self.word_rows)])
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            self.weights[i] = self.words.weight(w)
            for k, v in self.words.near(w).items():
                self.word_rows[i] += v * self.word_score[k]
        return i

    def _pair(self, key: int) -> int:
        i = self.pair_ids.get(key)
        if i is None:
            i = self.pair_ids[key] = len(self.pair_ids)
            if i >= len(self.pair_rows):
                self.pair_rows = np.concatenate([self.pair_rows, np.zeros_like(self.pair_rows)])
            na, nb = self.words.near(self.names[key >> 32]), self.words.near(self.names[key & 0xFFFFFFFF])
            for k, v in na.items():
                for j, n in self.first.get(k, ()):
                    if j in nb:
                        self.pair_rows[i] += v * nb[j] * self.pair_score[n]
        return i

    def passages(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Per token list its decision values, and per category where its best window starts and ends.

        The values of a list are the highest of its windows of ``WINDOWS`` words and of
        the whole; one of fewer than two words is no passage.
        """
        if len(self.ids) > 300_000 or len(self.pair_ids) > 600_000:
            self._forget()
        size = np.array([len(u) for u in units], np.int64)
        flat = np.array([self._id(w) for u in units for w in u], np.int64)
        c = len(CATEGORIES)
        best, where = np.full((len(units), c), -1.0), np.zeros((len(units), c, 2), np.int64)
        if not len(flat):
            return best, where
        owner = np.repeat(np.arange(len(units)), size)
        start = np.cumsum(size) - size
        keys, back = np.unique((flat[:-1] << 32) | flat[1:], return_inverse=True)
        rows = np.array([self._pair(int(k)) for k in keys], np.int64)
        pair = self.pair_rows[rows[back]] if len(keys) else np.zeros((0, c))
        pair = np.where((owner[:-1] == owner[1:])[:, None], pair, 0.0)
        cw = np.concatenate([np.zeros((1, c)), np.cumsum(self.word_rows[flat], 0)])
        cp = np.concatenate([np.zeros((1, c)), np.cumsum(pair, 0)])
        cu = np.concatenate([np.zeros(1), np.cumsum(self.weights[flat])])

        def take(lo: np.ndarray, hi: np.ndarray, who: np.ndarray) -> None:
            v = self.bias + (cw[hi] - cw[lo] + cp[hi - 1] - cp[lo]) / np.sqrt(np.maximum(1.0, 2.0 * (cu[hi] - cu[lo])))[:, None]
            for j in range(c):
                order = np.lexsort((v[:, j], who))
                last = order[np.append(np.flatnonzero(np.diff(who[order])), len(order) - 1)]
                better = last[v[last, j] > best[who[last], j]]
                best[who[better], j] = v[better, j]
                where[who[better], j] = np.stack([lo[better] - start[who[better]], hi[better] - start[who[better]]], 1)

        ok = np.flatnonzero(size >= 2)
        if len(ok):
            best[ok] = -np.inf
            take(start[ok], start[ok] + size[ok], ok)
        for n in WINDOWS:
            lo = np.flatnonzero(np.arange(len(flat)) - start[owner] + n < size[owner])
            if len(lo):
                take(lo, lo + n, owner[lo])
        return best, where

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """Highest decision values of each document's passages, per category."""
        units, owner = [], []
        for i, t in enumerate(texts):
            if not t or not t.strip():
                continue
            body = plain(t)
            parts = PASSAGE.split(body)
            if "\n" in body:
                #: Sentences that go over hard line ends are read whole as well.
                parts += [" ".join(s.split()) for s in WHOLE.split(body) if "\n" in s]
            for s in parts:
                u = tokens(s) if s else ()
                if len(u) >= 2:
                    units.append(u)
                    owner.append(i)
        out = np.full((len(texts), len(CATEGORIES)), -1.0)
        if units:
            np.maximum.at(out, np.array(owner), self.passages(units)[0])
        return out

    def scores(self, text: str | None) -> list[float]:
        return self.batch([text])[0].tolist()


def sample_sentences(texts: list[str], most: int = 12000) -> dict[str, int]:
    """Distinct sentences of the sample, as words, with the number of their texts.

    All that stand in ``OFTEN`` texts, and others evenly over the sample.
    """
    df: Counter = Counter()
    for t in texts:
        df.update({" ".join(u) for s in PASSAGE.split(C.content(t)) if len(s) < 300 and len(u := tokens(plain(s))) >= 2})
    rare = sorted(s for s in df if df[s] < OFTEN)
    return {s: df[s] for s in [*sorted(s for s in df if df[s] >= OFTEN), *rare[:: max(1, -(-len(rare) // most))]]}


_TRAINED: dict[int, Machine] = {}
#: Margins of the fits in turn: a sentence of rare words, which stands in fewer than
#: ``OFTEN`` texts of the sample, is taken for clean up to the first, and from the second
#: on for a case of its category; any other one is taken for clean.
ROUNDS = ((-0.6, 9.0), (-0.7, -0.1), (-0.7, -0.2), (-0.7, -0.25))
#: Clean sentences and sentences of its own that a fit takes at most.
CLEAN, OWN = 3000, 400
#: Sentences of so many texts of the sample are forms of the corpus, not cases.
OFTEN = 4


def train(texts: list[str], rows: list[tuple[str, str]] | None = None, common: dict[str, float] | None = None) -> Machine:
    """Fits on the labelled sentences, then with what each fit is sure of in the sample (self-training).

    ``common`` holds the weights of the corpus's common words.

    The first fit knows the labelled sentences only. Each later one takes as clean what
    the one before holds for clean, and as labelled sentences and landmarks of their own
    what it holds for a case by a margin. Sentences in between take no part.
    """
    key = hash((tuple(texts), tuple(rows or ()), tuple((common or {}).items())))
    if key not in _TRAINED:
        rows = rows or labelled(4)
        m = Machine(rows, {}, common=common)
        known = sample_sentences(texts)
        units, often = [s.split(" ") for s in known], np.array([*known.values()], np.int64)
        form = (often >= OFTEN) | np.array([max(map(m.words.weight, u)) < 1 for u in units], bool)
        for clean_to, case_from in ROUNDS:
            v, at = m.passages(units)
            top, cat = v.max(1), v.argmax(1)
            cut_ = lambda i: " ".join(units[i][at[i, cat[i], 0] : at[i, cat[i], 1]])
            own = sorted({(CATEGORIES[cat[i]], cut_(i)) for i in np.flatnonzero((top >= case_from) & ~form)})
            clean = np.flatnonzero((top <= clean_to) | form)
            clean = clean[np.argsort(-top[clean], kind="stable")]
            clean = np.append(clean[: CLEAN // 3], clean[CLEAN // 3 :: max(1, -(-len(clean) // CLEAN))])
            #: Clean sentences count whole, by the root of their texts, and by the window that looks worst.
            least = dict(sorted(({cut_(i): 1.0 for i in clean} | {" ".join(units[i]): float(often[i]) ** 0.5 for i in clean}).items()))
            m = Machine(rows, least, own[:: max(1, -(-len(own) // OWN))], m.words)
        _TRAINED.clear()  # the last machine is kept for a second query over the same table
        _TRAINED[key] = m
    return _TRAINED[key]


def word_weights(documents: DataFrame) -> dict[str, float]:
    """Weights below 1 of the common words, from the number of distinct texts with each, over all documents.

    At most as many words are collected as 403 texts hold, however large the table is.
    """
    once = C.once(documents, "text")
    words = F.explode(F.array_append(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))), F.lit(""))).alias("word")
    counts = C.cut(once.select(words, "one").groupBy("word").agg(F.round(F.sum("one"), 3).alias("n")))
    n = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0.0
    top = min(TOP_WEIGHT, math.log((1 + n) / (1 + OFTEN)))
    least = (1 + n) / math.exp(top) - 1
    df: Counter = Counter()
    for word, c in counts.where((F.col("word") != "") & (F.col("n") > least)).collect():
        for w in tokens(word):
            df[w] += c
    return {w: max(0.0, math.log((1 + n) / (1 + c)) / top) ** 2 for w, c in sorted(df.items())} if top > 0 else {}


def scored(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): decision values; above ``CASE`` is a case."""
    model = documents.sparkSession.sparkContext.broadcast(train(C.sample_texts(documents, "text", sample_rows), common=word_weights(documents)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = model.value
        s = np.concatenate([m.batch(list(pdf["text"].iloc[a : a + 500])) for a in range(0, len(pdf), 500)])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], **{c: s[:, j] for j, c in enumerate(CATEGORIES)}})

    cols = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return C.map_texts(cols, "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES), run)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(C.table(spark, sf_dir, "documents"))
    cats = F.array(*[F.when(F.col(c) > CASE, F.lit(c)) for c in CATEGORIES])
    return s.select("doc_id", F.explode(F.array_compact(cats)).alias("category")).distinct()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_docs, abusive, hateful, sexual): share of each source's documents."""
    s = scored(C.table(spark, sf_dir, "documents")).groupBy("source", "doc_id").agg(*[F.max(F.col(c) > CASE).alias(c) for c in CATEGORIES])
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), *[F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in CATEGORIES])


QUERIES = {"p10_found": found, "p10_rates": rates}
