"""Sentence alignment of bilingual results (problem 7).

Method: a geometric search of the bitext space. Points are words of both texts that
correspond: equal numbers, names and shelf marks, cognates, and word pairs of a lexicon
learned from the corpus. Words that stand in too many places give no points. The points
of a pair of sentences make a cell; cells that carry little of the weight of their row
and of their column are noise. From each remaining cell a rectangle grows towards the
origin, by doubling, until it holds cells that a chain can come from: cells in order,
whose step keeps the slope of the texts within ``MAX_DEVIATION``. The best chains are taken in turn; each claims its
sentences, so later chains hold only what lies off the map: inversions, moved sentences.
The cells of a chain become blocks: a link each, where the words of either sentence are
covered by the other to ``COVER``; further sentences join a linked neighbour as a merge
if they add words of their own. What no chain passes is left without counterpart.

The rarity of words is counted over all requested pairs. The lexicon is a translation
model (IBM model 1) of all requested pairs: those of a pair of languages are split by
hash into parts of about ``PART_ROWS`` results, each is fitted in a task of its own, and
the expected counts of all parts are added up before probabilities are taken. A part is
fitted first on sentences tied by unique points, then on the links found with its first form.

Texts are split, numbered and read for their language once (``scan``); fitting and alignment
take the tokens from there. The spaces of many pairs of texts are searched together
(``Spaces``), with words as numbers; only the chains run pair by pair.

Cases: null, empty or blank texts on either side give no rows; cost grows with the points, not with the
product of the sentence counts; of equal chains the one that ends first is taken, of equal
cells the lower numbers; repeated rows give one result; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from . import langdata
from .p4_pairs import LanguageBayes

#: Results of one pair of languages that are fitted together, in a task; the parts' counts are added up.
PART_ROWS = 500
#: Expected counts of a part below this are not handed on; a word pair needs 1.2 in all.
LEAST_COUNT = 0.01
#: Up to so many requests their keys are broadcast; beyond, the texts are shuffled.
BROADCAST_ROWS = 200_000
#: The weight of numbers, and of every word that stands in less than 1 of 403 sentences.
TOP_WEIGHT = 6.0
COVER = 0.42
#: Word pairs of the lexicon have a greater expected count and probability than these.
LEAST_TIES, LEAST_P = 1.2, 0.03
#: A word with more places than this, source times target, gives no points.
AMBIGUITY = 16
#: Cells of less point weight, or of less than ``NOISE`` of the heaviest of their row and of their column, are noise.
LIGHT, NOISE = 2.0, 0.3
#: The largest rectangle, in sentences, and how far a step may leave the slope.
REACH = 16
MAX_DEVIATION = 0.75
#: What a cell must bring to a chain, and what a skipped sentence costs it.
DUE, SKIP = 0.3, 0.02
#: Matches that are held against cells at once, and letters of texts that are aligned at once.
AT_ONCE = 1 << 20
#: A block must be worth so much of the best cell of either of its sentences.
RIVAL = 0.8
SPLIT = re.compile(r"(?<=[.!?])\s+")
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[^\W_]*\d[\w.,\-]*\d|\d")
JOINED = re.compile(r"(?<=[^\W\d_])[-¬‐­]\s*\n\s*(?=[a-zß-ÿ])")
#: Word pairs by the words' numbers: source words, target words, and a count or probability of each.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def numbered(text: str | None) -> list[str]:
    """Sentences in the order that numbers them: number = position + 1."""
    body = C.content(text).strip()
    return [s for s in SPLIT.split(body) if s.strip()] if body else []


def fold(w: str) -> str:
    w = w.lower()
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def tokens(sentence: str) -> list[str]:
    """Lower-case tokens; numbers without separators."""
    s = JOINED.sub("", sentence) if "\n" in sentence else sentence
    return [t.replace(".", "").replace(",", "") if t[-1].isdigit() else t.lower() for t in TOKEN.findall(s)]


class Lexicon:
    """Word translation probabilities both ways, and the rarity of words."""

    def __init__(self):
        #: Per pair of languages: source word -> target word -> probability.
        self.by_pair: dict[tuple[str, str], dict[str, dict[str, float]]] = {}
        self.idf: dict[str, float] = {}
        self.top = 8.0

    def weight(self, w: str) -> float:
        if w[-1].isdigit():
            return TOP_WEIGHT
        return min(self.idf.get(w, self.top), TOP_WEIGHT)

    def fit_idf(self, df: dict[str, int], n: int) -> None:
        """Rarity from the number of sentences with each word, out of n."""
        self.top = math.log(1 + n)
        self.idf = {w: math.log((1 + n) / (1 + c)) for w, c in df.items()}

    def table(self, langs: tuple[str, str], vocab: dict[str, int]) -> Table:
        """The word pairs of two languages of which both words are numbered, by those numbers."""
        to = self.by_pair.get(langs, {})
        rows = [(i, vocab[x], p) for w, i in vocab.items() if w in to for x, p in to[w].items() if x in vocab]
        w, x, p = zip(*rows) if rows else ((), (), ())
        return np.array(w, np.int64), np.array(x, np.int64), np.array(p, float)


def expand(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners 0, 1, ... as often as n has it, and the elements' numbers within each owner."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


class Side:
    """The sentences of one side of many pairs of texts, numbered through; their distinct words by number."""

    def __init__(self, texts: list[list[list[str]]], vocab: dict[str, int]):
        word, n, doc, size, letters = [], [], [], [], []
        for d, text in enumerate(texts):
            for x in text:
                ws = [vocab.setdefault(w, len(vocab)) for w in dict.fromkeys(x)]
                word += ws
                n.append(len(ws))
                doc.append(d)
                size.append(len(x))
                letters.append(sum(map(len, x)) + 1)
        #: Per sentence: its text, its tokens, its letters, its distinct words and the first of these.
        self.doc, self.size, self.letters, self.n = (np.array(x, np.int64) for x in (doc, size, letters, n))
        self.first = np.cumsum(self.n) - self.n
        #: Per distinct word of a sentence.
        self.word, self.sent = np.array(word, np.int64), np.repeat(np.arange(len(n)), self.n)
        #: The first sentence of each text, and the end.
        self.begin = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def group(self, size: int) -> None:
        """Groups: a word of a text, and the sentences that hold it."""
        key = self.doc[self.sent] * size + self.word
        order = np.argsort(key, kind="stable")
        at = begins(key[order])
        self.key, self.count, self.start = key[order][at], np.diff(np.append(at, len(key))), at
        self.text, self.of = np.divmod(self.key, size)
        self.members = self.sent[order]
        self.own = np.empty(len(key), np.int64)
        self.own[order] = np.repeat(np.arange(len(at)), self.count)

    def middles(self, d: int) -> list[float]:
        """The middle of each sentence of a text, in letters from its beginning."""
        n = self.letters[self.begin[d] : self.begin[d + 1]]
        return (np.cumsum(n) - n / 2).tolist()


class Spaces:
    """The bitext spaces of many pairs of texts of two languages: corresponding words, cells, and covers of cells.

    What doesn't depend on the lexicon is found once; ``match`` takes a lexicon's word pairs in.
    """

    def __init__(self, docs: list[tuple[list[list[str]], list[list[str]]]], lex: Lexicon):
        self.vocab: dict[str, int] = {}
        self.s, self.t = s, t = Side([x for x, _ in docs], self.vocab), Side([x for _, x in docs], self.vocab)
        size = max(1, len(self.vocab))
        s.group(size)
        t.group(size)
        self.docs, self.size = len(docs), size
        self.weight = np.array([lex.weight(w) for w in self.vocab], float)
        self.sums = tuple(np.maximum(np.bincount(x.sent, self.weight[x.word], len(x.n)), 1e-9) for x in (s, t))
        self.lettered = np.array([not w[-1].isdigit() for w in self.vocab], bool)
        self.holds = np.sort(t.sent * max(1, len(t.key)) + t.own)
        same = self._find(s.key)
        #: Words that correspond whatever the lexicon has: source group, target group, strength.
        self.equal = np.flatnonzero(same >= 0), same[same >= 0]
        self.alike = self._cognates()
        self.match(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The target groups of these keys, or -1."""
        if not len(self.t.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.t.key, key), len(self.t.key) - 1)
        return np.where(self.t.key[at] == key, at, -1)

    def _cognates(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups of one text whose words have five letters or more and share most of their beginning.

        That is the first five; of words of just five letters the first four.
        """
        stems: dict[str, int] = {}
        five, four = np.full(self.size, -1), np.full(self.size, -1)
        for w, i in self.vocab.items():
            f = fold(w)
            if len(f) >= 5:
                five[i] = stems.setdefault(f[:5], len(stems))
                if len(f) == 5:
                    four[i] = stems.setdefault(f[:4], len(stems))
        out = []
        for stem in (five, four):
            g = np.flatnonzero(self.lettered[self.s.of] & (stem[self.s.of] >= 0)) if len(self.s.of) else np.zeros(0, np.int64)
            h = np.flatnonzero(stem[self.t.of] >= 0) if len(self.t.of) else np.zeros(0, np.int64)
            width = len(stems) + 1
            key = self.t.text[h] * width + stem[self.t.of[h]]
            order = np.argsort(key, kind="stable")
            key, h = key[order], h[order]
            want = self.s.text[g] * width + stem[self.s.of[g]]
            low = np.searchsorted(key, want)
            own, no = expand(np.searchsorted(key, want, "right") - low)
            out.append((g[own], h[low[own] + no]))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def match(self, w: np.ndarray, x: np.ndarray, p: np.ndarray) -> None:
        """Takes in word pairs of a lexicon, and finds the cells."""
        s, t = self.s, self.t
        order = np.argsort(w, kind="stable")
        w, x, p = w[order], x[order], p[order]
        low = np.searchsorted(w, s.of)
        own, no = expand(np.where(self.lettered[s.of], np.searchsorted(w, s.of, "right") - low, 0) if len(s.of) else np.zeros(0, np.int64))
        pair = low[own] + no
        to = self._find(s.text[own] * self.size + x[pair])
        hit = to >= 0
        g = np.concatenate([self.equal[0], own[hit], self.alike[0]])
        h = np.concatenate([self.equal[1], to[hit], self.alike[1]])
        strength = np.concatenate([np.ones(len(self.equal[0])), np.minimum(1.0, 0.5 + p[pair[hit]]), np.full(len(self.alike[0]), 0.8)])
        #: Equal words first, then the lexicon's, then cognates.
        _, first = np.unique(g * max(1, len(t.key)) + h, return_index=True)
        self.g, self.h, self.p = g[first], h[first], strength[first]
        self.at = np.searchsorted(self.g, np.arange(len(s.key) + 1))
        few = np.flatnonzero(s.count[self.g] * t.count[self.h] <= AMBIGUITY)
        rows, cols = s.count[self.g[few]], t.count[self.h[few]]
        own, no = expand(rows * cols)
        a, b = np.divmod(no, cols[own])
        i, j = s.members[s.start[self.g[few]][own] + a], t.members[t.start[self.h[few]][own] + b]
        value = self.weight[s.of[self.g[few]]] * self.p[few] / cols
        cell, inverse = np.unique(i * max(1, len(t.n)) + j, return_inverse=True)
        #: Cells in order: source and target sentence, weight of their points.
        self.i, self.j = np.divmod(cell, max(1, len(t.n)))
        self.v = np.bincount(inverse, value[own], len(cell))

    def kept(self) -> np.ndarray:
        """Which cells are no noise."""
        row, col = np.zeros(len(self.s.n)), np.zeros(len(self.t.n))
        np.maximum.at(row, self.i, self.v)
        np.maximum.at(col, self.j, self.v)
        return (self.v >= LIGHT) & ((self.v >= NOISE * row[self.i]) | (self.v >= NOISE * col[self.j]))

    def covers(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the weight of source sentences i and of target sentences j that have a counterpart in the other."""
        of_word = np.diff(self.at)[self.s.own]
        work = np.cumsum(np.bincount(self.s.sent, of_word, len(self.s.n))[i]) // AT_ONCE
        at = begins(work).tolist()
        out = [self._covers(i[a:b], j[a:b], of_word) for a, b in zip(at, [*at[1:], len(i)])]
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in (0, 1))

    def _covers(self, i: np.ndarray, j: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, t, groups = self.s, self.t, max(1, len(self.t.key))
        cell, no = expand(s.n[i])
        entry = s.first[i][cell] + no
        own, no = expand(of_word[entry])
        pair = self.at[s.own[entry]][own] + no
        cell, h = cell[own], self.h[pair]
        key = j[cell] * groups + h
        hit = np.flatnonzero(self.holds[np.minimum(np.searchsorted(self.holds, key), len(self.holds) - 1)] == key) if len(key) else key
        own, cell, h, p = own[hit], cell[hit], h[hit], self.p[pair[hit]]
        at = begins(own)
        got = np.bincount(cell[at], (np.maximum.reduceat(p, at) if len(at) else p) * self.weight[s.word[entry[own[at]]]], len(i))
        key = cell * groups + h
        order = np.argsort(key, kind="stable")
        at = begins(key[order])
        back = np.bincount(cell[order][at], (np.maximum.reduceat(p[order], at) if len(at) else p) * self.weight[t.of[h[order][at]]], len(i))
        return got / self.sums[0][i], back / self.sums[1][j]

    def blocks(self, cover: float = COVER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of all texts: source sentence, target sentence, score."""
        keep = np.flatnonzero(self.kept())
        i, j = self.i[keep], self.j[keep]
        cs, ct = self.covers(i, j)
        gain = 0.5 * np.maximum(cs, ct) + 0.5 * np.sqrt(cs * ct) - DUE
        at = np.searchsorted(self.s.doc[i], np.arange(self.docs + 1))
        i, j, gain, both = i.tolist(), j.tolist(), gain.tolist(), list(zip(cs.tolist(), ct.tolist()))
        out: list[tuple[int, int, float]] = []
        for d in range(self.docs):
            a, b = at[d], at[d + 1]
            if a < b:
                x, y = int(self.s.begin[d]), int(self.t.begin[d])
                cells = [(i[k] - x, j[k] - y) for k in range(a, b)]
                out += [(k + x, m + y, v) for k, m, v in claimed(dict(zip(cells, gain[a:b])), dict(zip(cells, both[a:b])), self.s.middles(d), self.t.middles(d), cover)]
        k, m, v = zip(*out) if out else ((), (), ())
        return np.array(k, np.int64), np.array(m, np.int64), np.array(v, float)


class Space:
    """The bitext space of two texts."""

    def __init__(self, s: list[list[str]], t: list[list[str]], lex: Lexicon, langs: tuple[str, str]):
        self.all = Spaces([(s, t)], lex)
        self.all.match(*lex.table(langs, self.all.vocab))
        self.cells = {(i, j): v for i, j, v in zip(self.all.i.tolist(), self.all.j.tolist(), self.all.v.tolist())}

    def covers(self, i: int, j: int) -> tuple[float, float]:
        """Shares of the weight of source sentence i and of target sentence j that have a counterpart in the other."""
        a, b = self.all.covers(np.array([i]), np.array([j]))
        return float(a[0]), float(b[0])

    def kept(self) -> list[tuple[int, int]]:
        """Cells that are no noise, in order."""
        return [c for c, k in zip(self.cells, self.all.kept()) if k]


def chains(cells: list[tuple[int, int]], gain: dict[tuple[int, int], float], xs: list[float], ys: list[float], slope: float) -> list[list[tuple[int, int]]]:
    """Slope-consistent chains through the cells, best first, none sharing a cell.

    A cell's rectangle towards the origin doubles until a chain can come from it; a cell
    without one begins a chain.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for c in cells:
        rows.setdefault(c[0], []).append(c)
    slack = slope * (xs[-1] / max(1, len(xs))) + ys[-1] / max(1, len(ys))
    best: dict[tuple[int, int], float] = {}
    back: dict[tuple[int, int], tuple[int, int] | None] = {}
    for c in cells:
        i, j = c
        top, frm, size, low = 0.0, None, 1, 0
        while size <= REACH and frm is None:
            for k in range(max(0, i - size), i + 1):
                for q in rows.get(k, ()):
                    if q[1] > j or q[1] < j - size or q == c or q not in best or (i - k <= low and j - q[1] <= low):
                        continue
                    dx, dy = (xs[i] - xs[k]) * slope, ys[j] - ys[q[1]]
                    if abs(dx - dy) <= MAX_DEVIATION * (dx + dy) / 2 + slack:
                        v = best[q] - SKIP * (max(0, i - k - 1) + max(0, j - q[1] - 1))
                        if v > top:
                            top, frm = v, q
            size, low = size * 2, size
        best[c], back[c] = gain[c] + top, frm
    out, used = [], set()
    for c in sorted(best, key=lambda c: (-best[c], c)):
        chain = []
        q: tuple[int, int] | None = c
        while q is not None and q not in used:
            chain.append(q)
            used.add(q)
            q = back[q]
        if chain and sum(gain[x] for x in chain) > 0:
            out.append(chain[::-1])
    return out


def claimed(gain: dict[tuple[int, int], float], covers: dict[tuple[int, int], tuple[float, float]], xs: list[float], ys: list[float], cover: float) -> list[tuple[int, int, float]]:
    """Links (source, target, score) of two texts, from their cells."""
    slope = max(ys[-1], 1.0) / max(xs[-1], 1.0)
    of_s: dict[int, list[int]] = {}
    of_t: dict[int, list[int]] = {}
    links: dict[tuple[int, int], float] = {}
    row: dict[int, float] = {}
    col: dict[int, float] = {}
    for (i, j), v in gain.items():
        row[i], col[j] = max(row.get(i, 0.0), v + DUE), max(col.get(j, 0.0), v + DUE)
    alive = sorted(c for c, v in gain.items() if v > -0.1)
    while alive:
        before, tried = len(links), set()
        for chain in chains(alive, gain, xs, ys, slope):
            #: The strongest cells of a chain claim their sentences first.
            for i, j in sorted(chain, key=lambda c: (-gain[c], c)):
                cs, ct = covers[i, j]
                both = math.sqrt(cs * ct)
                new_i, new_j = i not in of_s, j not in of_t
                if new_i and new_j:
                    ok = max(cs, ct) >= cover and both >= 0.9 * cover and gain[i, j] + DUE >= RIVAL * max(row[i], col[j])
                elif new_i:  # one more source sentence for a target that has one
                    ok = cs >= cover + 0.13 and ct >= 0.25 and min(abs(i - k) for k in of_t[j]) == 1
                elif new_j:
                    ok = ct >= cover + 0.13 and cs >= 0.25 and min(abs(j - k) for k in of_s[i]) == 1
                else:
                    ok = False
                tried.add((i, j))
                if ok:
                    links[i, j] = gain[i, j] + DUE
                    of_s.setdefault(i, []).append(j)
                    of_t.setdefault(j, []).append(i)
            if len(links) > before:
                break  # what a chain has claimed is out of the next search
        if not tried:
            break
        alive = [c for c in alive if c not in tried and (c[0] not in of_s or c[1] not in of_t)]
    return [(i, j, v) for (i, j), v in sorted(links.items())]


def blocks(s: list[list[str]], t: list[list[str]], lex: Lexicon, langs: tuple[str, str], cover: float = COVER) -> list[tuple[int, int, float]]:
    """Links (source, target, score) between the sentences of two texts."""
    space = Spaces([(s, t)], lex)
    space.match(*lex.table(langs, space.vocab))
    return list(zip(*(x.tolist() for x in space.blocks(cover))))


class Languages:
    """The language of most of a text, by naive Bayes over the seed passages."""

    def __init__(self):
        self.bayes = LanguageBayes([(k, v) for k, v in langdata.SEEDS.items() if k in langdata.LANGS])

    def of(self, sentences: list[str]) -> str:
        return self.each([sentences])[0]

    def each(self, texts: list[list[str]]) -> list[str]:
        """The language of each text; none for a text without sentences."""
        out = [""] * len(texts)
        for k in range(0, len(texts), 500):
            has = [i for i in range(k, min(k + 500, len(texts))) if texts[i]]
            if has:
                flat = [s for i in has for s in texts[i]]
                n = [len(texts[i]) for i in has]
                p = np.add.reduceat(self.bayes.posteriors(flat) * np.array([[len(s)] for s in flat]), np.cumsum(n) - n, axis=0)
                for i, best in zip(has, p.argmax(1)):
                    out[i] = self.bayes.codes[int(best)]
        return out


def word_counts(texts: list[list[list[str]]]) -> tuple[Counter, int]:
    """The number of sentences that hold each word, and of all sentences."""
    return Counter(itertools.chain.from_iterable(set(s) for t in texts for s in t)), sum(map(len, texts))


def sentence_counts(texts: list[str]) -> tuple[Counter, int]:
    """``word_counts`` of texts as they are stored."""
    return word_counts([[tokens(s) for s in numbered(t)] for t in texts])


def packed(text: list[list[str]]) -> str:
    """A line for each sentence, its tokens between blanks; neither stands in a token."""
    return "\n".join(map(" ".join, text))


def unpacked(text: str) -> list[list[str]]:
    return [x.split(" ") if x else [] for x in text.split("\n")]


def scan(pairs: DataFrame) -> DataFrame:
    """The one pass over the texts: rows with a word and its sentences per batch, and a row for each pair with its languages and tokens."""
    who = pairs.sparkSession.sparkContext.broadcast(Languages())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [[numbered(x) for x in pdf[c]] for c in ("extracted_text", "translation")]
            s, t = ([[tokens(x) for x in text] for text in side] for side in parts)
            df, n = word_counts([*s, *t])
            yield pd.DataFrame([("", n), *df.items()], columns=["word", "n"]).assign(job_id=None, file_index=0, a=None, b=None, h=0, s=None, t=None)
            a, b = map(who.value.each, parts)
            yield pd.DataFrame({"word": None, "n": 0, "job_id": pdf["job_id"], "file_index": pdf["file_index"], "a": a, "b": b, "h": pdf["h"], "s": [*map(packed, s)], "t": [*map(packed, t)]})

    hashed = pairs.withColumn("h", F.xxhash64("extracted_text", "translation"))
    return C.cut(hashed.mapInPandas(run, "word string, n long, job_id string, file_index int, a string, b string, h long, s string, t string"))


def rarity(scanned: DataFrame) -> tuple[dict[str, int], int]:
    """Sentence counts over all pairs, of the words that may weigh less than ``TOP_WEIGHT``.

    Those are at most as many as 403 sentences have words, however large the table is.
    """
    counts = C.cut(scanned.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    n = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    least = (1 + n) / math.exp(TOP_WEIGHT) - 1
    return {r[0]: r[1] for r in counts.where((F.col("word") != "") & (F.col("n") > least)).collect()}, n


def quotas(have: dict[tuple[str, str], int], rows: int) -> dict[tuple[str, str], int]:
    """Rows of each pair of languages: small pairs whole, the others alike."""
    out, left = {}, rows
    for i, (k, n) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0]))):
        out[k] = min(n, max(1, left // (len(have) - i)))
        left -= out[k]
    return out


def sample_pairs(pairs: DataFrame, scanned: DataFrame, rows: int) -> DataFrame:
    """(a, b, extracted_text, translation) of at most so many results, drawn by hash within each pair of languages."""
    spark = pairs.sparkSession
    langs = scanned.where("word is null AND a <> '' AND b <> '' AND a <> b").select("job_id", "file_index", "a", "b").distinct()
    quota = quotas({(r[0], r[1]): r[2] for r in langs.groupBy("a", "b").count().collect()}, rows)
    shares = F.broadcast(spark.createDataFrame([(*k, v) for k, v in quota.items()], "a string, b string, quota int"))
    #: A share of the hashes that holds about three quotas goes into the ranking, no whole pair of languages.
    total = langs.groupBy("a", "b").agg(F.count("*").alias("total"))
    near = langs.join(shares, ["a", "b"]).join(F.broadcast(total), ["a", "b"]).withColumn("h", F.xxhash64("job_id", "file_index"))
    near = near.where((F.col("total") <= 3 * F.col("quota")) | (F.pmod("h", F.lit(1 << 20)) < F.greatest(F.lit(1), (F.lit(3 << 20) * F.col("quota") / F.col("total")).cast("long"))))
    order = Window.partitionBy("a", "b").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "job_id", "file_index")
    drawn = near.withColumn("no", F.row_number().over(order)).where("no <= quota").select("job_id", "file_index", "a", "b")
    tokened = scanned.where("word is null").select("job_id", "file_index", "h", "s", "t").distinct().join(F.broadcast(drawn), ["job_id", "file_index"])
    texts = pairs.withColumn("h", F.xxhash64("extracted_text", "translation")).join(F.broadcast(drawn.select("job_id", "file_index")), ["job_id", "file_index"], "left_semi")
    return texts.join(tokened, ["job_id", "file_index", "h"]).select("a", "b", "extracted_text", "translation", "h", "s", "t").distinct()


def all_pairs(pairs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(a, b, part, h, s, t) of every result; a part has about ``PART_ROWS`` results of two languages, either way round."""
    langs = scanned.where("word is null AND a <> '' AND b <> '' AND a <> b").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    parts = langs.select("low", "high", "a", "job_id", "file_index").distinct().groupBy("low", "high").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    return langs.join(F.broadcast(parts), ["low", "high"]).select("a", "b", F.pmod(F.xxhash64("job_id", "file_index"), F.col("parts")).cast("int").alias("part"), "h", "s", "t")


def expected(i: np.ndarray, j: np.ndarray, spaces: Spaces, rounds: int = 5) -> Callable[[bool], tuple[Table, Table]]:
    """IBM model 1 of tied sentences: for either way round the expected counts of word pairs, and of words with any word (its second numbers are -1)."""
    s, t = spaces.s, spaces.t
    ok = (s.n[i] > 0) & (t.n[j] > 0) & (s.size[i] <= 60) & (t.size[j] <= 60)
    i, j = i[ok], j[ok]
    own, no = expand(s.n[i] * t.n[j])
    a, b = np.divmod(no, t.n[j][own])
    src, tgt = s.word[s.first[i][own] + a], t.word[t.first[j][own] + b]
    #: Numbers of the words of each side, without gaps.
    names = [np.unique(x) for x in (src, tgt)]
    place = [np.zeros(spaces.size, np.int64) for _ in names]
    for x, y in zip(place, names):
        x[y] = np.arange(len(y))
    width = max(1, len(names[1]))
    key = place[0][src] * width + place[1][tgt]
    if len(names[0]) * width <= 16 * len(key):
        inv = np.zeros(len(names[0]) * width, np.int64)
        inv[key] = 1
        pairs = np.flatnonzero(inv)
        inv[pairs] = np.arange(len(pairs))
        inv = inv[key]
    else:
        pairs, inv = np.unique(key, return_inverse=True)
    sides = np.divmod(pairs, width)
    #: The word of a tied sentence that its counterparts share out.
    shared = (np.cumsum(t.n[j]) - t.n[j])[own] + b, (np.cumsum(s.n[i]) - s.n[i])[own] + a

    def counts(back: bool) -> tuple[Table, Table]:
        of, to, by, p = sides[back], sides[not back], shared[back], np.ones(len(pairs))
        count, total = np.zeros(len(pairs)), np.zeros(len(names[back]))
        for _ in range(rounds if len(pairs) else 0):
            v = p[inv]
            v = v / np.bincount(by, v)[by]
            count = np.bincount(inv, v, len(pairs))
            total = np.bincount(of, count, len(names[back]))
            p = count / total[of]
        return (names[back][of], names[not back][to], count), (names[back], np.full(len(total), -1), total)

    return counts


def likely(counts: tuple[Table, Table], size: int) -> Table:
    """Word pairs with their probabilities, from expected counts."""
    (w, x, n), (of, _, total) = counts
    every = np.ones(size)
    every[of] = total
    ok = (n > LEAST_TIES) & (n > LEAST_P * every[w])
    return w[ok], x[ok], n[ok] / every[w[ok]]


def fit_counts(docs: list[tuple[list[list[str]], list[list[str]]]], lex: Lexicon) -> tuple[dict[str, int], tuple[Table, Table], tuple[Table, Table]]:
    """The words' numbers, and the expected counts of two languages, both ways, from the sentences of their pairs of texts."""
    spaces = Spaces(docs, lex)
    i, j = spaces.i, spaces.j
    cs, ct = spaces.covers(i, j)
    sim = np.sqrt(cs * ct)
    best = [np.zeros(len(i), bool) for _ in range(2)]
    for out, own, other in zip(best, (i, j), (j, i)):
        order = np.lexsort((other, -sim, own))
        out[order[begins(own[order])]] = True
    anchor = best[0] & best[1] & (sim > 0.12)
    i, j = i[anchor], j[anchor]
    gap = np.flatnonzero((np.diff(i) == 2) & (np.diff(j) == 2) & (np.diff(spaces.s.doc[i]) == 0))
    i, j = np.append(i, i[gap] + 1), np.append(j, j[gap] + 1)
    for _ in range(2):
        spaces.match(*likely(expected(i, j, spaces)(False), spaces.size))
        i, j, v = spaces.blocks()
        i, j = i[v > 0.45], j[v > 0.45]
    counts = expected(i, j, spaces)
    return spaces.vocab, counts(False), counts(True)


def fit_pair(docs: list[tuple[list[list[str]], list[list[str]]]], langs: tuple[str, str], lex: Lexicon) -> tuple[dict[str, dict[str, float]], dict[str, dict[str, float]]]:
    """The word tables of one pair of languages, both ways."""
    vocab, *both = fit_counts(docs, lex)
    words, out = list(vocab), ({}, {})
    for to, counts in zip(out, both):
        for w, x, p in zip(*likely(counts, len(words))):
            to.setdefault(words[w], {})[words[x]] = float(p)
    return out


def fit(drawn: DataFrame, counts: tuple[dict[str, int], int]) -> Lexicon:
    """The lexicon from the parts of each pair of languages (either way round), each in a task of its own; rarity from the counts."""
    spark = drawn.sparkSession
    lex = Lexicon()
    lex.fit_idf(*counts)
    shared = spark.sparkContext.broadcast(lex)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        a, b, _ = (x.as_py() for x in key)
        pdf = rows.select(["a", "h", "s", "t"]).to_pandas().drop_duplicates(["a", "h"]).sort_values(["s", "t"])
        docs = [(unpacked(s), unpacked(t)) if x == a else (unpacked(t), unpacked(s)) for x, s, t in zip(pdf["a"], pdf["s"], pdf["t"])]
        vocab, *both = fit_counts(docs, shared.value)
        words, out = pa.array([*vocab, ""], pa.string()), []
        for (x, y), (pairs, totals) in zip(((a, b), (b, a)), both):
            w, v, n = (np.concatenate([p[pairs[2] >= LEAST_COUNT], q]) for p, q in zip(pairs, totals))
            out.append(pa.table({"a": pa.repeat(x, len(n)), "b": pa.repeat(y, len(n)), "src": words.take(pa.array(w)), "tgt": words.take(pa.array(np.where(v < 0, len(vocab), v))), "n": pa.array(n)}))
        return pa.concat_tables(out)

    drawn = drawn.select("a", "h", "s", "t", "part", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    tasks = drawn.select("low", "high", "part").distinct().count()
    drawn = drawn.repartition(max(8, spark.sparkContext.defaultParallelism, tasks // 2), "low", "high", "part")  # a number of our own: small groups would else share one task
    counts = C.cut(drawn.groupBy("low", "high", "part").applyInArrow(one, "a string, b string, src string, tgt string, n double").groupBy("a", "b", "src", "tgt").agg(F.round(F.sum("n"), 6).alias("n")))
    totals = counts.where("tgt = ''").select("a", "b", "src", F.col("n").alias("total"))
    table = counts.where((F.col("tgt") != "") & (F.col("n") > LEAST_TIES)).join(totals, ["a", "b", "src"]).where(F.col("n") > LEAST_P * F.col("total"))
    for a, b, w, x, p in table.select("a", "b", "src", "tgt", F.col("n") / F.col("total")).orderBy("a", "b", "src", "tgt").collect():
        lex.by_pair.setdefault((a, b), {}).setdefault(w, {})[x] = p
    return lex


def aligned(requests: DataFrame, results: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """(job_id, file_index, src_no, tgt_no, score) for the requested results; the lexicon may be fitted on at most ``sample_rows`` of them."""
    spark = results.sparkSession
    both = results.select("job_id", F.col("file_index").cast("int").alias("file_index"), "extracted_text", "translation").where("length(trim(extracted_text)) > 0 and length(trim(translation)) > 0")
    keys = requests.select("job_id", F.col("file_index").cast("int").alias("file_index")).distinct()
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    pairs = both.join(keys, ["job_id", "file_index"], "left_semi")
    scanned = scan(pairs)
    drawn = all_pairs(pairs, scanned) if sample_rows is None else sample_pairs(pairs, scanned, sample_rows).withColumn("part", F.lit(0))
    model = spark.sparkContext.broadcast(fit(drawn, rarity(scanned)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lex, out = model.value, []
        for langs, own in pdf.groupby(["a", "b"], sort=False):
            for _, few in own.groupby((own["s"].str.len() + own["t"].str.len()).cumsum() // AT_ONCE):
                spaces = Spaces([(unpacked(s), unpacked(t)) for s, t in zip(few["s"], few["t"])], lex)
                spaces.match(*lex.table(langs, spaces.vocab))
                i, j, v = spaces.blocks()
                d = spaces.s.doc[i]
                out.append(pd.DataFrame({"job_id": few["job_id"].to_numpy()[d], "file_index": few["file_index"].to_numpy()[d], "src_no": i - spaces.s.begin[d] + 1, "tgt_no": j - spaces.t.begin[d] + 1, "score": v}))
        return pd.concat(out)

    texts = scanned.where("word is null").select("job_id", "file_index", "a", "b", "s", "t")
    return C.map_texts(texts, "job_id string, file_index int, src_no int, tgt_no int, score double", run)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(C.table(spark, sf_dir, "align_requests"), C.table(spark, sf_dir, "results")).select("job_id", "file_index", "src_no", "tgt_no").distinct()


QUERIES = {"p7_found": found}
