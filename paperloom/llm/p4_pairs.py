"""Broken prompt and response pairs (problem 4).

Method: character n-gram naive Bayes gives the language posteriors of prompt and
response, sentence by sentence; their comparison finds answers in another language
and answers that stay in the prompt's language (an exact comparison of word pairs then
decides on copies). The likelihood that a text ends after its last tokens, from an
n-gram model of token shapes, decides on truncated answers at the threshold
``END_LIKELIHOOD``; the automaton of problem 3 adds what it holds open and field limits,
which no likelihood shows, and takes signatures and dates out. The n-grams are counted over all answers, as are the words of answers that do not refuse; languages
are learned from a bounded sample of labelled rows. A word naive Bayes separates refusals of a model from letters
that refuse something.

Cases: null or blank answers, and answers of punctuation or a bare lead-in, are
``empty``; answers with residue of problem 6 are not counted; one defect per pair,
in the order empty, refusal, copy, wrong_language, truncated; a null or unknown
target language can't be missed; repeated rows of either table give one result;
texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import langdata, p3_truncation, p6_residue
from .exemplars import ANSWERS, REFUSALS
from .p2_language import grams, weight, whole_sentences

END_LIKELIHOOD = 0.03
COPY_SHARE = 0.6
IN_TARGET = 0.2
REFUSAL_SCORE = 0.7
#: A term counts as seen in other answers where that moves its log odds by so much.
LEAST_ODDS = 0.02
LEAD_IN = re.compile(r"\A\s*(?:[`\"'*_ ]*)(?:[^\n.!?]{0,60}?(?:translation|übersetzung|traduction|traducción|tradução)[^\n.!?]{0,40}?[:：])[*_]*\s*", re.I)
SIGN = re.compile(r"[^\W_]")
WRAP = re.compile(r"</?source_document>|^```\w*\s*$", re.M)


def answer_text(text: str | None) -> str:
    """A response without lead-in, fences and the request's wrapping."""
    t = C.content(text)
    if "<" in t or "```" in t:
        t = WRAP.sub("", t)
    m = LEAD_IN.match(t)
    return t[m.end() :] if m else t


class LanguageBayes:
    """Character n-gram naive Bayes over words; log likelihoods are kept per word."""

    def __init__(self, labelled: list[tuple[str, str]]):
        self.codes = sorted({k for k, _ in labelled}, key=lambda k: (langdata.LANGS + tuple(langdata.SEEDS)).index(k))
        count = {k: Counter() for k in self.codes}
        for k, s in labelled:
            c = count[k]
            for w in C.WORD.findall(s.lower()):
                c.update(grams(w))
        vocab = sorted({g for c in count.values() for g in c})
        self.at = {g: i for i, g in enumerate(vocab)}
        m = np.zeros((len(vocab) + 1, len(self.codes)), np.float32)
        for j, k in enumerate(self.codes):
            for g, n in count[k].items():
                m[self.at[g], j] = n
        self.table = np.log((m + 0.1) / (m.sum(0) + 0.1 * len(m))).astype(np.float32)
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.codes)), np.float32)

    def _word(self, w: str) -> int:
        i = self.words.get(w)
        if i is None:
            i = self.words[w] = len(self.words)
            if i >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[i] = self.table[[self.at.get(g, -1) for g in grams(w)]].sum(0)
        return i

    def posteriors(self, passages: list[str], words: list[list[str]] | None = None) -> np.ndarray:
        """Posterior of each language for each passage, under equal priors. ``words``: the lower-case words of each, if known."""
        if len(self.words) > 150_000:
            self.words = {}
        every, start, has = [], [], []
        for i, ws in enumerate((C.WORD.findall(s.lower()) for s in passages) if words is None else words):
            if ws:
                has.append(i)
                start.append(len(every))
                every += ws
        at = list(map(self.words.get, every))
        if None in at:
            at = [self._word(w) for w in every]
        out = np.full((len(passages), len(self.codes)), 1 / len(self.codes), np.float32)
        if at:
            ll = np.add.reduceat(self.rows[np.array(at)], np.array(start), axis=0)
            e = np.exp(ll - ll.max(1, keepdims=True))
            out[has] = e / e.sum(1, keepdims=True)
        return out

    def shares(self, texts: list[str]) -> list[dict[str, float]]:
        """Per text the share of its letters in each language, by sentence posteriors."""
        flat, words, owner, size = [], [], [], []
        for i, t in enumerate(texts):
            for s in whole_sentences(t):
                low = s.lower()
                ws = C.WORD.findall(low)
                n = weight(s, ws if len(low) == len(s) else None)  # few capitals become two characters
                if n >= 10:
                    flat.append(s)
                    words.append(ws)
                    owner.append(i)
                    size.append(n)
        out: list[dict[str, float]] = [{} for _ in texts]
        if flat:
            post = self.posteriors(flat, words)
            total = np.bincount(owner, size, len(texts))
            per = np.zeros((len(texts), len(self.codes)))
            np.add.at(per, owner, post * np.array(size)[:, None])
            for i in np.flatnonzero(total):
                out[i] = {k: float(v / total[i]) for k, v in zip(self.codes, per[i]) if v / total[i] > 0.01}
        return out


class Marks(dict):
    """The mark of each token, kept once made."""

    def __missing__(self, x: str) -> str:
        self[x] = m = ("N" if len(x) > 1 else "n") if x[0] == "\n" else "9" if x[0].isdigit() else ("W" if x[0].isupper() else "w") if x[0].isalpha() else x
        return m


class EndModel:
    """Likelihood that a text ends after its last tokens: backed-off n-grams of token shapes.

    Words count as lower-case or capitalised, numbers as one shape, punctuation and line
    ends as themselves; so the model knows no language. A text is the string of its
    shapes, one character each. Fitted twice: texts that the first model takes for
    unfinished are left out. It holds the counts of the n-grams that texts end with.
    """

    TOKEN = re.compile(r"\n+|[^\W\d_]+|\d+|[^\w\s]|_")
    ORDER = 6
    MARKS = Marks()

    def __init__(self, texts: list[str]):
        kept = [(self.shapes(t.rstrip()), 1.0) for t in texts]
        tails: Counter = Counter()
        for t, n in kept:
            tails[t[-self.ORDER :]] += n
        wanted = self.wanted(tails)
        self.fit(tails, self.grams(kept, wanted), lambda out: self.grams([x for x in kept if x[0][-self.ORDER :] in out], wanted))

    @classmethod
    def shapes(cls, t: str) -> str:
        """A mark for the beginning, then one character a token."""
        if len(cls.MARKS) > 200_000:
            cls.MARKS.clear()
        return "N" + "".join(map(cls.MARKS.__getitem__, cls.TOKEN.findall(t)))

    @classmethod
    def wanted(cls, tails: dict[str, float]) -> set[str]:
        return {t[-n:] for t in tails for n in range(1, len(t) + 1)}

    @classmethod
    def grams(cls, texts: list[tuple[str, float]], wanted: set[str]) -> Counter:
        """Occurrences of each wanted n-gram; under the empty one that of all tokens."""
        out: Counter = Counter()
        for share in sorted({one for _, one in texts}):
            c: Counter = Counter()
            for t, one in texts:
                if one == share:
                    c.update(t)
                    c[""] += len(t)
                    part = t
                    for n in range(1, cls.ORDER):  # each n-gram and the character after it
                        part = list(map(add, part, t[n:]))
                        c.update(part)
            for g in c.keys() & (wanted | {""}):
                out[g] += c[g] * share
        return out

    def fit(self, tails: dict[str, float], seen: dict[str, float], grams_of: Callable[[set[str]], dict[str, float]]) -> None:
        """From the number of texts by their last shapes and of all n-grams; ``grams_of`` gives those of the texts left out."""
        self._set(tails, seen)
        out = {t for t in tails if self._likelihood(t) < END_LIKELIHOOD / 8}
        if out:
            less = grams_of(out)
            self._set({t: n for t, n in tails.items() if t not in out}, {g: n - less.get(g, 0.0) for g, n in seen.items()})

    def _set(self, tails: dict[str, float], seen: dict[str, float]) -> None:
        self.seen, self.ends = dict(seen), Counter()
        for t, c in tails.items():
            for n in range(1, len(t) + 1):
                self.ends[t[-n:]] += c
        self.base = sum(tails.values()) / max(1.0, seen.get("", 0.0))

    def _likelihood(self, tail: str) -> float:
        p = self.base
        for n in range(1, len(tail) + 1):
            c = tail[-n:]
            if self.seen.get(c, 0.0) < 1e-6:
                break
            p = (self.ends[c] + 4 * p) / (self.seen[c] + 4)
        return p

    def likelihood(self, text: str) -> float:
        t = text.rstrip()
        k = self.shapes(t[-120:])
        if len(k) <= self.ORDER + 2:  # the tokens that count may lie further back
            k = self.shapes(t)
        return self._likelihood(k[-self.ORDER :])


class RefusalBayes:
    """Word and word-pair naive Bayes of refusals against other answers.

    Other answers are half letters that refuse or excuse something, half any
    sentence; a term that no class has seen says nothing.
    """

    ALPHA = 0.002

    def __init__(self, refusals: list[str], letters: list[str], others: dict[str | tuple[str, str], float]):
        yes, letter = ({k: n / len(x) for k, n in Counter(w for t in x for w in set(self._terms(t))).items()} for x in (refusals, letters))
        #: Log odds of each term that a class has seen; ``others`` holds shares of the sentences.
        self.odds = {w: math.log(yes.get(w, 0.0) + self.ALPHA) - math.log(0.5 * letter.get(w, 0.0) + 0.5 * others.get(w, 0.0) + self.ALPHA) for w in {*yes, *letter, *others}}

    @staticmethod
    def _terms(t: str) -> list[str | tuple[str, str]]:
        ws = C.WORD.findall(t.lower())
        return [*ws, *zip(ws, ws[1:])]

    def score(self, t: str) -> float:
        """Mean log odds of a refusal over the sentence's terms."""
        terms = set(self._terms(t))
        if len(terms) < 3:
            return -1.0
        return sum(self.odds[w] for w in terms if w in self.odds) / len(terms)

    def refuses(self, text: str) -> bool:
        """An answer of up to three sentences whose first refuses, or one that mostly refuses."""
        ss = [s for s in C.sentences(text) if weight(s) > 6]
        if not ss:
            return False
        hits = 0
        for left, s in zip(range(len(ss) - 1, -1, -1), ss):
            hits += self.score(s) > REFUSAL_SCORE
            if hits * 2 > len(ss) or (hits and left == len(ss) - 1 and len(ss) <= 3):
                return True
            if (hits + left) * 2 <= len(ss) and (len(ss) > 3 or left < len(ss) - 1 or not hits):
                return False  # the rest can't change it
        return False


def copied(source: str, answer: str) -> float:
    """Share of the answer's pairs of neighbouring words that the source has too."""
    a, b = C.WORD.findall(source.lower()), C.WORD.findall(answer.lower())
    if len(b) < 3:
        return 0.0
    have, want = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return sum((want & have).values()) / (len(b) - 1)


def is_copy(source: str, answer: str, least: float) -> bool:
    """Whether ``copied`` is ``least`` or more; most others show by the words that the source lacks."""
    b = C.WORD.findall(answer.lower())
    if len(b) < 3:
        return least <= 0
    have = set(C.WORD.findall(source.lower()))
    return sum(map(have.__contains__, b[:-1])) / (len(b) - 1) >= least and copied(source, answer) >= least


def read_answers(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One pass over all answers: (shape, full, one) of each, and (term, n) over their sentences.

    ``full`` are answers of twenty letters or more, which the end model is fitted on.
    Terms come from the sentences that the labelled rows alone do not take for a
    refusal; their number stands under the empty term. Each distinct answer counts once.
    """
    first = RefusalBayes(REFUSALS, ANSWERS, {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            #: Answers that stand equally often are counted together.
            by_share: dict[float, Counter] = {}
            for t, one in zip(pdf["translation"], pdf["one"]):
                own = by_share.setdefault(one, Counter())
                for s in C.sentences(t):
                    ws = set(first._terms(s))
                    if len(ws) < 3 or sum(map(first.odds.__getitem__, ws & first.odds.keys())) / len(ws) < REFUSAL_SCORE:
                        own.update(ws)
                        own[""] += 1
            terms: dict = by_share.pop(1.0, Counter())
            for one, own in by_share.items():
                for w, n in own.items():
                    terms[w] += n * one
            yield pd.DataFrame({"shape": [EndModel.shapes(answer_text(t).rstrip()) for t in pdf["translation"]], "full": [weight(t) >= 20 for t in pdf["translation"]], "one": pdf["one"], "term": None, "n": 0.0})
            yield pd.DataFrame({"shape": None, "full": False, "one": 0.0, "term": [w if isinstance(w, str) else " ".join(w) for w in terms], "n": [float(n) for n in terms.values()]})

    rows = C.once(results, "translation").mapInPandas(run, "shape string, full boolean, one double, term string, n double")
    rows = C.cut(rows)
    return rows.where("shape is not null").select("shape", "full", "one"), rows.where("term is not null").select("term", "n")


def end_model(shapes: DataFrame) -> EndModel:
    """The end model of all answers; the driver sees their last shapes only."""
    tail = F.expr(f"right(shape, {EndModel.ORDER})").alias("tail")
    rows = shapes.groupBy(tail).agg(F.sum(F.when(F.col("full"), F.col("one")).otherwise(0.0)).alias("n")).collect()
    tails = {r.tail: round(r.n, 6) for r in rows if r.n > 0}
    wanted = shapes.sparkSession.sparkContext.broadcast(EndModel.wanted({r.tail: 0.0 for r in rows}))

    def grams_of(df: DataFrame) -> dict[str, float]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame(list(EndModel.grams(list(zip(pdf["shape"], pdf["one"])), wanted.value).items()), columns=["gram", "n"])

        got = df.select("shape", "one").mapInPandas(run, "gram string, n double").groupBy("gram").agg(F.sum("n").alias("n"))
        return {r.gram: round(r.n, 6) for r in got.collect()}

    def left_out(out: set[str]) -> dict[str, float]:
        return grams_of(full.join(F.broadcast(shapes.sparkSession.createDataFrame([(t,) for t in sorted(out)], "tail string")), tail == F.col("tail"), "left_semi"))

    full = shapes.where("full")
    model = EndModel([])
    if tails:
        model.fit(tails, grams_of(full), left_out)
    return model


def other_answers(terms: DataFrame) -> dict[str | tuple[str, str], float]:
    """The share of all sentences that hold each term, of the terms whose log odds it moves by ``LEAST_ODDS``.

    At most as many terms are collected as ``1 / LEAST_ODDS / ALPHA`` sentences hold.
    """
    counts = C.cut(terms.groupBy("term").agg(F.round(F.sum("n"), 3).alias("n")))
    n = counts.where("term = ''").agg(F.sum("n")).first()[0] or 0.0
    return {tuple(r.term.split(" ")) if " " in r.term else r.term: r.n / n for r in counts.where((F.col("term") != "") & (F.col("n") > 2 * LEAST_ODDS * RefusalBayes.ALPHA * n)).collect()}


def pair_kinds(src: list[str], raw: list[str], ans: list[str], bayes: LanguageBayes, refusal: RefusalBayes, index: p6_residue.Index) -> tuple[list[str], dict[int, dict[str, float]]]:
    """The kind of each pair (``none`` where nothing shows), and the languages of the answers that are neither empty nor residue.

    Languages are looked up only where they decide: of those answers, and of the sources
    whose pairs of words the answer has. ``ans`` are the ``answer_text`` of ``raw``.
    """
    kinds = ["empty" if not SIGN.search(t) else "residue" if index.matches(r) else "none" for r, t in zip(raw, ans)]
    left = [i for i, k in enumerate(kinds) if k == "none"]
    langs = dict(zip(left, bayes.shares([ans[i] for i in left])))
    alike = []
    for i, la in langs.items():
        if refusal.refuses(ans[i]):
            kinds[i] = "refusal"
        elif is_copy(C.content(src[i]), ans[i], COPY_SHARE if la else 0.9):
            if la:
                alike.append(i)
            elif weight(ans[i]) >= 10:
                kinds[i] = "copy"
    for i, ls in zip(alike, bayes.shares([src[i] for i in alike])):
        if ls and max(langs[i], key=langs[i].get) == max(ls, key=ls.get):
            kinds[i] = "copy"
    return kinds, langs


def checked(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Per result: what its pair of texts shows, short and without the texts."""
    bayes = LanguageBayes(langdata.labelled_sample(documents))
    shapes, terms = read_answers(results)
    refusal = RefusalBayes(REFUSALS, ANSWERS, other_answers(terms))
    model = results.sparkSession.sparkContext.broadcast((bayes, end_model(shapes), refusal, p6_residue.index_for(results)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bayes, ends, refusal, index = model.value
        out, whole = [], ("closed", "closing", True)
        for a in range(0, len(pdf), 500):
            part = pdf.iloc[a : a + 500]
            src = [t or "" for t in part["extracted_text"]]
            ans = [answer_text(t) for t in part["translation"]]
            kinds, langs = pair_kinds(src, list(part["translation"]), ans, bayes, refusal, index)
            for i, (j, f, raw, t, kind) in enumerate(zip(part["job_id"], part["file_index"], part["translation"], ans, kinds)):
                if i not in langs:
                    out.append((j, f, 0, 0, kind, *whole, [], []))
                    continue
                la = langs[i]
                structure, shape, ended = p3_truncation.tail_of(raw)
                if structure != "broken" and shape != "closing" and ends.likelihood(t) < END_LIKELIHOOD:
                    structure = "broken"
                elif structure == "closed" and not ended and shape in p3_truncation.PRIOR:
                    shape = "heading"  # the likelihood takes the place of the terminators' baseline
                top = sorted(la, key=la.get, reverse=True)
                out.append((j, f, len(raw), len(raw.encode("utf-8", "replace")), kind, structure, shape, ended, top, [la[k] for k in top]))
        return pd.DataFrame(out, columns=["job_id", "file_index", "n_chars", "n_bytes", "kind", "structure", "shape", "terminated", "langs", "shares"])

    cols = results.select("job_id", F.col("file_index").cast("int").alias("file_index"), "extracted_text", F.col("translation").cast("string").alias("translation"))
    return C.map_texts(cols, "job_id string, file_index int, n_chars int, n_bytes int, kind string, structure string, shape string, terminated boolean, langs array<string>, shares array<double>", run)


def defects(results: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(job_id, file_index, model, target, defect) of each pair with a defect."""
    code = F.lower(F.trim(F.regexp_extract("target_lang", r"^\s*([^\s(_-]+)", 1)))
    names = F.create_map(*[F.lit(x) for k, v in langdata.NAMES.items() for n in v.split() for x in (n, k)])
    q = requests.select("job_id", F.col("file_index").cast("int").alias("file_index"), F.col("model").alias("source"), F.try_element_at(names, code).alias("target")).distinct()
    e = C.cut(checked(results, documents).join(q, ["job_id", "file_index"]).withColumn("fld", F.lit("translation")).withColumn("source", F.coalesce("source", F.lit("unknown"))).distinct())
    e = p3_truncation.truncated(e)
    in_target = F.when(F.array_position("langs", F.col("target")) > 0, F.element_at("shares", F.array_position("langs", F.col("target")).cast("int"))).otherwise(0.0)
    defect = (
        F.when(F.col("kind").isin("empty", "refusal", "copy"), F.col("kind"))
        .when((F.col("kind") == "none") & F.col("target").isNotNull() & (F.size("langs") > 0) & (in_target < IN_TARGET), "wrong_language")
        .when((F.col("kind") == "none") & F.col("truncated"), "truncated")
    )
    return e.withColumn("defect", defect).where("defect is not null").select("job_id", "file_index", F.col("source").alias("model"), "target", "defect")


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: C.table(spark, sf_dir, n)
    return defects(t("results"), t("translation_requests"), t("documents"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = "array_position(array('empty','refusal','copy','wrong_language','truncated'), defect)"
    return _of(spark, sf_dir).groupBy("job_id", "file_index").agg(F.expr(f"min_by(defect, {rank})").alias("defect"))


def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, defect, n): pairs with each defect by translating model."""
    return _of(spark, sf_dir).distinct().groupBy("model", "defect").agg(F.count("*").alias("n"))


QUERIES = {"p4_found": found, "p4_by_model": by_model}
