"""Noise of the scanned page: split words, misread letters, running titles, page numbers (problem 1).

Method: every word of the corpus is counted; rare words retrieve correction candidates
among frequent words through an inverted join on positional character q-grams; gradient
boosted trees rank the candidates and choose replacements. A word of letters alone that
is not far rarer than its replacement may be a word of its own; the share of its texts
that hold a sure misreading or two unsure ones besides decides. These are ratios, so a table's size doesn't
matter. Boosted classifiers of line
pairs decide on joins (a line's last piece and the next line's first) and on furniture
(a line and its neighbours: running title, page number or text). ``repaired`` returns
each text as continuous paragraphs; ``found`` reports the defects.

The classifiers are fitted on pages set from a bounded sample of clean sentences
(``SAMPLE_ROWS``) into which noise is written; word counts, candidate search and
application cover all texts. Corrections are broadcast while there are at most
``BROADCAST_WORDS`` of them, and joined by word beyond that.

``regions`` is read as its values in the order of their keys, as pages of one text.

Cases: null, empty and blank texts, null and empty maps and null values have no
defects; very long texts are worked on whole; a word whose best candidates tie takes
the more frequent, then the first in order; repeated rows give one result; an empty
table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .linear import Boosted
from .p3_truncation import NUMERAL, PAGE_NO, is_title

SAMPLE_ROWS = 1200
#: A correction must be this many times as frequent as the word, however often that stands.
RATIO = 12
#: A misreading is sure if it has signs among its letters or is rarer by ``SURE_RATIO``; else
#: ``COMPANY`` of the texts it stands in must hold a sure one or two unsure ones besides.
SURE_RATIO = 100
COMPANY = 0.5
#: Corrections that are broadcast at most; beyond, they are joined by word.
BROADCAST_WORDS = 1_000_000
#: Words that count as frequent enough for a lexicon of joins: at least one of so many of the corpus.
LEXICON_SHARE = 20_000_000
#: Parts that the words of a hot gram are spread over.
SALTS = 8
MISREAD_WORDS = 3
REPLACE_P = 0.5
JOIN_P = 0.5
FURNITURE_P = 0.5
#: Letters that scanning mistakes for others, as (printed, read).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("i", "|"), ("l", "|"), ("l", "i"), ("i", "l"), ("s", "5"), ("s", "$"), ("b", "6"), ("b", "8"), ("g", "9"), ("g", "q"), ("a", "@"), ("a", "o"), ("o", "a"), ("t", "+"), ("t", "f"), ("f", "t"),
    ("h", "b"), ("b", "h"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("n", "ri"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("w", "vv"), ("ü", "ii"), ("u", "ii"), ("h", "li"), ("k", "lc"), ("ö", "o"), ("ä", "a"), ("ü", "u"), ("z", "2"), ("q", "g"), ("y", "v"), ("r", "n"), ("ß", "b"), ("ß", "8"), ("é", "e"), ("á", "a"), ("é", "6"), ("ó", "6"), ("ó", "0"), ("ã", "5"), ("í", "!"), ("í", "1"), ("á", "@"), ("ä", "a´"), ("ö", "o´"),
)
READ = {}
for _a, _b in CONFUSIONS:
    READ.setdefault(_b, set()).add(_a)
EDGE = ".,;:?()[]\"'«»“”„*–—·…¿¡{}<>_/\\`"
HYPHEN = "-¬‐­"
PAIR = re.compile(r"([^\W\d_][^\s\-¬‐­]*)([-¬‐­])(?:[ \t\r]*(\n)\s*|[ \t]+)([^\W\d_][^\s\-]*)")
ANY_PAIR = re.compile(r"[-¬‐­]\s")
LETTER = re.compile(r"[^\W\d_]")
STOP = frozenset("und oder bzw sowie and or to nor et ou y o u e ou bis als".split())
CODE = re.compile(r"^[a-z]{1,2}\d+(?:-\d+)?$|^\d+[rv]?$|^\d(?![^\W\d_]{4})|^[ivxlcdm]+$")


def split_pairs(text: str) -> Iterator[re.Match]:
    """The matches of ``PAIR``, sought from the hyphens: its first piece begins with the first letter of what stands before one."""
    done = 0
    for h in ANY_PAIR.finditer(text):
        end = a = h.start()
        while a > done and not text[a - 1].isspace() and text[a - 1] not in HYPHEN:
            a -= 1
        if (first := LETTER.search(text, a, end)) and (m := PAIR.match(text, first.start())):
            yield m
            done = m.end()


# ---------------------------------------------------------------- words


TOKENS = re.compile(r"[^\s.,;:?()\[\]\"'«»“”„*–—·…¿¡{}<>_/\\`]+")


CALL = re.compile(r"!+(?=\s|$)")
#: An apostrophe inside a word after a or o stands for the dots of the letter before it.
ACCENT = re.compile(r"'(?<=[aoAO].)(?=[a-zäöüß])")


def words(text: str) -> list[str]:
    """Lower-case words with their inner signs; punctuation and split pieces are off."""
    low = text.lower()
    if "'" in low:
        low = ACCENT.sub("´", low)
    if "!" in low:
        low = CALL.sub(" ", low)
    return [w for w in TOKENS.findall(low) if w[-1] not in HYPHEN]


def is_word(w: str) -> bool:
    """Words that corrections are looked for: mostly letters, no codes or markup."""
    if not 2 <= len(w) <= 30 or CODE.match(w) or w.count("-") > 1:
        return False
    letters = sum(c.isalpha() for c in w)
    return letters >= 2 and len(w) - letters <= max(1, 0.45 * len(w)) and not any(c in w for c in "=<>{}\\/\"%&:;") and not ("@" in w and "." in w)


def pages_text(regions) -> str:
    """Values of a region map in the order of their keys, one page after another."""
    if regions is None:
        return ""
    items = regions.items() if isinstance(regions, dict) else list(regions)
    order = lambda kv: (0, int(kv[0]), "") if str(kv[0]).lstrip("-").isdigit() else (1, 0, str(kv[0]))
    return "\n\n".join(v for _, v in sorted(items, key=order) if v)


def both_fields(results: DataFrame) -> DataFrame:
    """(job_id, file_index, fld, text): the extracted text and the pages of the regions."""
    keys = [F.col("job_id"), F.col("file_index").cast("int").alias("file_index")]
    num = lambda e: F.coalesce(e.getField("key").try_cast("int"), F.lit(2**31 - 1))
    entries = F.array_sort(
        F.filter(F.map_entries("regions"), lambda e: e.getField("value").isNotNull()),
        lambda a, b: F.when(num(a) < num(b), -1).when(num(a) > num(b), 1).when(a.getField("key") < b.getField("key"), -1).when(a.getField("key") > b.getField("key"), 1).otherwise(0),
    )
    pages = F.array_join(F.transform(entries, lambda e: e.getField("value")), "\n\n")
    pairs = F.array(F.struct(F.lit("extracted_text").alias("fld"), F.col("extracted_text").alias("text")), F.struct(F.lit("regions").alias("fld"), pages.alias("text")))
    return results.select(*keys, F.explode(pairs).alias("x")).select("job_id", "file_index", "x.fld", "x.text").where("length(trim(text)) > 0")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts: counted per batch, then summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for t in pdf["text"]:
                c.update(words(C.content(t)))
            rows = [(w, n) for w, n in c.items() if is_word(w)]
            yield pd.DataFrame(rows, columns=["word", "n"])

    return texts.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def candidates(counts: DataFrame) -> DataFrame:
    """(word, n, cand, m, shared): frequent words that share positional q-grams with a word.

    Pairs of letters for words up to five letters, triples beyond; a gram may stand one
    place further left or right in the candidate, whose length differs by one at most.
    """
    size = F.length("word")
    q = F.when(size <= 5, 2).otherwise(3)
    grams = lambda qq: F.transform(F.sequence(F.lit(1), F.length("word") + 3 - qq), lambda i: F.struct(i.cast("int").alias("pos"), F.substring(F.concat(F.lit("^"), F.col("word"), F.lit("$")), i, qq).alias("gram")))
    need = F.col("n") * RATIO
    ask = counts.select("word", "n", need.alias("need"), size.alias("len"), q.alias("q"), F.explode(F.when(size <= 5, grams(F.lit(2))).otherwise(grams(F.lit(3)))).alias("g"))
    ask = ask.select("word", "n", "need", "len", "q", "g.gram", F.explode(F.array(F.col("g.pos") - 1, F.col("g.pos"), F.col("g.pos") + 1)).alias("pos"))
    plain = counts.where((F.col("n") >= RATIO) & F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*[\p{L}]$"))
    have = plain.select(F.col("word").alias("cand"), F.col("n").alias("m"), size.alias("clen"), F.explode(F.array(F.lit(2), F.lit(3))).alias("q"))
    have = have.where((F.col("q") == 2) & (F.col("clen") <= 6) | (F.col("q") == 3) & (F.col("clen") >= 5))
    have = have.withColumn("g", F.explode(F.transform(F.sequence(F.lit(1), F.col("clen") + 3 - F.col("q")), lambda i: F.struct(i.cast("int").alias("pos"), F.substring(F.concat(F.lit("^"), F.col("cand"), F.lit("$")), i, F.col("q")).alias("gram")))))
    have = have.select("cand", "m", "clen", "q", "g.pos", "g.gram")
    #: Pairs of letters and word beginnings are hot: their words are spread over salts.
    hot = (F.col("q") == 2) | F.col("gram").startswith("^")
    ask = ask.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("word"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    have = have.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hit = ask.join(have, ["q", "gram", "pos", "salt"]).where((F.abs(F.col("len") - F.col("clen")) <= 1) & (F.col("m") >= F.col("need")))
    shared = hit.groupBy("word", "cand").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("len").alias("len"), F.first("q").alias("q"), F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= F.greatest(F.lit(1), F.ceil(F.col("len") * 0.3).cast("int"))).drop("len", "q")


def edits(word: str, cand: str) -> tuple[float, int, int]:
    """(cost, edits, known confusions) of the cheapest reading of ``cand`` as ``word``.

    A known confusion of one or two letters costs 0.3, a sign in a letter's place 0.5,
    any other change 1.
    """
    a, b = len(word), len(cand)
    inf = (99.0, 9, 0)
    prev = [[inf] * (b + 1) for _ in range(a + 1)]
    prev[0][0] = (0.0, 0, 0)
    for i in range(a + 1):
        for j in range(b + 1):
            cur = prev[i][j]
            if cur[0] > 3:
                continue
            if i < a and j < b:
                if word[i] == cand[j]:
                    step = cur
                elif cand[j] in READ.get(word[i], ()):
                    step = (cur[0] + 0.3, cur[1] + 1, cur[2] + 1)
                else:
                    step = (cur[0] + (1.0 if word[i].isalpha() else 0.5), cur[1] + 1, cur[2])
                if step < prev[i + 1][j + 1]:
                    prev[i + 1][j + 1] = step
            if i < a and (s := (cur[0] + 1, cur[1] + 1, cur[2])) < prev[i + 1][j]:
                prev[i + 1][j] = s
            if j < b and (s := (cur[0] + 1, cur[1] + 1, cur[2])) < prev[i][j + 1]:
                prev[i][j + 1] = s
            if i + 2 <= a and j < b and cand[j] in READ.get(word[i : i + 2], ()) and (s := (cur[0] + 0.3, cur[1] + 1, cur[2] + 1)) < prev[i + 2][j + 1]:
                prev[i + 2][j + 1] = s
            if i < a and j + 2 <= b and cand[j : j + 2] in READ.get(word[i], ()) and (s := (cur[0] + 0.3, cur[1] + 1, cur[2] + 1)) < prev[i + 1][j + 2]:
                prev[i + 1][j + 2] = s
    return prev[a][b]


def pair_features(word: str, cand: str, n: int, m: int, shared: int) -> list[float]:
    cost, k, known = edits(word, cand)
    signs = sum(not c.isalpha() and c not in "'’-" for c in word)
    return [cost, k, known, k - known, signs, len(word), cost / len(word), np.log1p(m) - np.log1p(n), np.log1p(n), np.log1p(m), shared / (len(word) + 1), len(word) - len(cand), float(word[0] == cand[0]), float(word[-1] == cand[-1])]


def misread(word: str, rnd: random.Random, times: int = 1) -> str:
    """A word with some letters read wrongly."""
    for _ in range(times):
        at = [(i, a, b) for a, b in CONFUSIONS for i in range(len(word)) if word.startswith(a, i)]
        if not at:
            return word
        i, a, b = rnd.choice(at)
        word = word[:i] + b + word[i + len(a) :]
    return word


def fit_replacements(vocab: Counter, seed: int = 1) -> Boosted:
    """Ranks (word, candidate) pairs; fitted on written misreadings and on other near words."""
    rnd = random.Random(seed)
    common = [w for w, _ in vocab.most_common(3000) if w.isalpha() and len(w) > 1] or ["alpha", "beta", "gamma", "delta"]
    near: dict[str, list[str]] = {}
    for w in common:
        for i in range(len(w)):
            near.setdefault(w[:i] + "_" + w[i + 1 :], []).append(w)
    letters = "abcdefghijklmnopqrstuvwxyz"
    x, y = [], []

    def add(w: str, c: str, label: int, n: int, m: int) -> None:
        if w == c or len(w) < 2:
            return
        q = 2 if len(w) <= 5 else 3
        gw = {(p + d, f"^{w}$"[p : p + q]) for p in range(len(w) + 3 - q) for d in (-1, 0, 1)}
        gc = {(p, f"^{c}$"[p : p + q]) for p in range(len(c) + 3 - q)}
        x.append(pair_features(w, c, n, m, len(gw & gc)))
        y.append(label)

    for c in common:
        m = int(10 ** rnd.uniform(1.5, 5))
        n = max(1, int(m / 10 ** rnd.uniform(1.1, 4)))
        w = misread(c, rnd, 1 if rnd.random() < 0.75 else 2)
        add(w, c, 1, n, m)
        others = [o for i in range(len(w)) for o in near.get(w[:i] + "_" + w[i + 1 :], ()) if o != c]
        for o in others[:1]:
            if edits(w, o)[0] > edits(w, c)[0]:
                add(w, o, 0, n, int(10 ** rnd.uniform(1.5, 5)))
        #: Rare words of their own: other endings, other letters, names.
        kind = rnd.randrange(5)
        if kind == 0:
            w = c + rnd.choice(["s", "n", "e", "r", "t", "en"])
        elif kind == 1:
            w = c[:-1]
        elif kind == 2:
            i = rnd.randrange(len(c))
            w = c[:i] + rnd.choice(letters) + c[i + 1 :]
        elif kind == 3:
            i = rnd.randrange(len(c) + 1)
            w = c[:i] + rnd.choice(letters) + c[i:]
        else:
            o = rnd.choice(common)
            w = o[: len(o) // 2] + c[len(c) // 2 :]
        cost, k, known = edits(w, c)
        if known == 0 or k > known:
            add(w, c, 0, n, m)
    return Boosted(trees=40, depth=4).fit(np.array(x, float), np.array(y, float))


def corrections(counts: DataFrame, model: Boosted) -> DataFrame:
    """(word, fix, p, sure): the chosen replacement of each word that looks misread."""
    shipped = counts.sparkSession.sparkContext.broadcast(model)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([pair_features(*r) for r in zip(pdf["word"], pdf["cand"], pdf["n"], pdf["m"], pdf["shared"])], float)
        #: A misread word is still that word: few changes, and hardly any that scanning doesn't make.
        ok = (x[:, 1] <= 1 + x[:, 5] // 5) & (x[:, 3] <= x[:, 5] // 9)
        pdf, x = pdf[ok], x[ok]
        pdf = pdf.assign(p=shipped.value.score(x))
        return pdf[pdf["p"] >= REPLACE_P][["word", "n", "cand", "m", "p"]]

    scored = C.map_texts(candidates(counts), "word string, n long, cand string, m long, p double", run)
    best = F.max_by(F.struct("cand", "p", "n", "m"), F.struct("p", "m", F.col("cand")))
    sure = ~F.col("word").rlike(r"^[\p{L}'’-]+$") | (F.col("b.m") >= F.col("b.n") * SURE_RATIO)
    return scored.groupBy("word").agg(best.alias("b")).select("word", F.col("b.cand").alias("fix"), F.col("b.p").alias("p"), sure.alias("sure"))


def in_company(texts: DataFrame, fixes: DataFrame) -> DataFrame:
    """The sure corrections, and the others whose texts mostly hold a sure misreading, or two unsure ones, besides."""
    if fixes.where("NOT sure").isEmpty():
        return fixes
    if fixes.count() <= BROADCAST_WORDS:
        known = texts.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in fixes.select("word", "sure").collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sure = known.value
            for pdf in batches:
                k, has = Counter(), Counter()
                for t in pdf["text"]:
                    ws = sure.keys() & set(words(C.content(t)))
                    open_ = [w for w in ws if not sure[w]]
                    k.update(open_)
                    if len(open_) < len(ws) or len(ws) >= MISREAD_WORDS:
                        has.update(open_)
                yield pd.DataFrame([(w, n, has[w]) for w, n in k.items()], columns=["word", "k", "has"])

        per = texts.select("text").mapInPandas(run, "word string, k long, has long").groupBy("word").agg(F.sum("k").alias("k"), F.sum("has").alias("has"))
    else:

        def every(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(j, f, c, w) for j, f, c, t in zip(pdf["job_id"], pdf["file_index"], pdf["fld"], pdf["text"]) for w in set(words(C.content(t))) if is_word(w)]
            return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "word"])

        at = C.map_texts(texts.distinct(), "job_id string, file_index int, fld string, word string", every).join(fixes.select("word", "sure"), "word")
        own = at.groupBy("job_id", "file_index", "fld").agg(F.collect_list(F.when(~F.col("sure"), F.col("word"))).alias("ws"), (F.max("sure") | (F.count("*") >= MISREAD_WORDS)).cast("long").alias("has"))
        per = own.select(F.explode("ws").alias("word"), "has").groupBy("word").agg(F.count("*").alias("k"), F.sum("has").alias("has"))
    return fixes.join(per, "word", "left").where(F.col("sure") | (F.col("has") >= F.col("k") * COMPANY)).select(fixes.columns)


# ---------------------------------------------------------------- lines


SIGNS = re.compile(r"[\W_]+")
ALIKE = str.maketrans("1!|0$5@+6896cq", "lllossatbbgbeg")
TITLE_NO = re.compile(r"^\s*(\d{1,5})\s{2,}(\S.*?)\s*$|^\s*(\S.*?)\s{2,}(\d{1,5})\s*$")


@lru_cache(4096)
def title_key(line: str) -> str:
    """Letters of a line, with letters that scanning confuses made equal."""
    s = SIGNS.sub("", line.lower().translate(ALIKE).replace("ii", "u").replace("ü", "u"))
    return s.replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("h", "b").replace("i", "l")


@lru_cache(4096)
def beside(line: str) -> tuple[str, int | None, int]:
    """(title part, number beside it, width of the gap)."""
    m = TITLE_NO.match(line)
    if not m:
        return line.strip(), None, 0
    title, no = (m.group(2), m.group(1)) if m.group(1) else (m.group(3), m.group(4))
    if not re.search(r"[^\W\d_]{2}|(?:[^\W\d_] ){3}", title):
        return line.strip(), None, 0
    gap = max((len(g) for g in re.findall(r"\s{2,}", line.strip())), default=0)
    return title, int(no), gap


class Lines:
    """The content lines of a text with the facts that line classifiers look at."""

    def __init__(self, text: str):
        self.lines: list[str] = []
        self.edge: list[bool] = []
        fresh = True
        for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            if x.startswith("#"):
                m = C.HEADERS.match(x)
                if m and m.end() < len(x):
                    x = x[m.end() :]
                else:
                    fresh = True
                    continue
            if not x.strip():
                fresh = fresh or not self.lines
                if self.lines:
                    self.lines.append("")
                    self.edge.append(fresh)
                continue
            self.lines.append(x)
            self.edge.append(fresh)
            fresh = False
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
            self.edge.pop()
        full = [i for i, x in enumerate(self.lines) if x.strip()]
        self.at = full
        self.keys: dict[str, list[int]] = {}
        self.parts: dict[int, tuple[str, int | None, int]] = {}
        self.wide = sorted(len(self.lines[i]) for i in full)[int(0.8 * len(full))] if full else 0
        for n, i in enumerate(full):
            x = self.lines[i]
            if len(x) <= 90 and not x.rstrip().endswith((".", "!", "?", ",", ";", ":", "-", "¬", "‐", "­")) and "\t" not in x and not x.startswith("|") and '"' not in x:
                p = self.parts[n] = beside(x)
                k = title_key(p[0])
                if 5 <= len(k) <= 60:
                    self.keys.setdefault(k, []).append(n)
        #: Titles with a misread letter join the most frequent like them.
        if len(self.keys) > 1:
            self._merge_near_keys()
        self.key_of = {n: k for k, ns in self.keys.items() for n in ns}
        numbers = [self._number(n) for n in range(len(full))]
        self.numbers = {n: v for n, v in enumerate(numbers) if v is not None}

    def _merge_near_keys(self) -> None:
        """Joins a title key to the most frequent near one.

        Near keys differ in few places, so they share one of the pieces that a key falls
        into, at the same number; an index of the pieces finds them, whatever the number of keys.
        """
        of: dict[str, list[tuple[int, str]]] = {}
        for k in self.keys:
            if len(k) >= 8:
                n = max(2, len(k) // 6) + 1
                size = len(k) // n
                of[k] = [(i, k[i * size : (i + 1) * size]) for i in range(n)]
        every = [p for ps in of.values() for p in ps]
        if len(set(every)) == len(every):
            return
        #: Pieces of one key alone lead to no other.
        pieces: dict[tuple[int, str], list[str]] = {p: [] for p, c in Counter(every).items() if c > 1}
        of = {k: own for k, ps in of.items() if (own := [p for p in ps if p in pieces])}
        for k, ps in of.items():
            for p in ps:
                pieces[p].append(k)
        for k in sorted(of, key=lambda k: (len(self.keys[k]), k)):
            near = {o for p in of[k] for o in pieces[p] if o != k and o in self.keys and abs(len(o) - len(k)) <= 1 and len(self.keys[o]) >= len(self.keys[k])}
            for o in sorted(near, key=lambda o: (-len(self.keys[o]), o)):
                if sum(a != b for a, b in zip(o, k)) <= max(2, len(k) // 6):
                    self.keys[o] = sorted(self.keys[o] + self.keys.pop(k))
                    break

    def _number(self, n: int) -> int | None:
        x = self.lines[self.at[n]].strip()
        if len(x) > 40 or x[:2].lower() in ("no", "nr") or not PAGE_NO.match(x) or x.endswith((".", "?", "!", ",", ";", ":")):
            return None
        m = re.search(r"\d{1,5}", x)
        if m:
            return int(m.group(0))
        r = re.sub(r"[\W_]", "", x).lower()
        v = roman(r)
        return v if v is not None and v < 400 and to_roman(v) == r else None

    def features(self, n: int) -> list[float]:
        """Facts of line n and its neighbours."""
        i = self.at[n]
        x = self.lines[i].strip()
        before = self.lines[self.at[n - 1]].strip() if n else ""
        after = self.lines[self.at[n + 1]].strip() if n + 1 < len(self.at) else ""
        part, no, gap = self.parts.get(n, (x, None, 0))
        mates = self.keys.get(self.key_of.get(n, ""), [])
        dist = min((abs(a - b) for a, b in zip(mates, mates[1:])), default=0)
        beside_no = [self.parts[k][1] for k in mates if self.parts.get(k, ("", None, 0))[1] is not None]
        num = self.numbers.get(n)
        others = [v for k, v in self.numbers.items() if k != n] if num is not None else []
        follows = min((abs(v - num) for v in others), default=99) if num is not None else 99
        letters = [c for c in x if c.isalpha()]
        return [
            float(num is not None), float(num if num is not None else -1), float(bool(re.match(r"^\W*[^\W\d_]", x)) and num is not None), float(min(follows, 99)), float(len(x)), float(len(letters)),
            float(len(mates)), float(dist), float(is_title(x)), float(no is not None), float(gap), float(len(set(beside_no)) > 1), float(before.endswith((".", "!", "?"))), float(after[:1].islower()),
            float(self.edge[i] or n == 0), float(n + 1 == len(self.at) or self.edge[self.at[n + 1]] or (i + 1 < len(self.lines) and not self.lines[i + 1].strip())), float(len(x)) / max(1, self.wide),
            float(x.endswith((".", "!", "?", ",", ";", ":"))), float("\t" in x or x.startswith("|")), float(len(self.at)), float(x[:1].islower()), float(x.startswith(("-", "•")) and num is None), float(bool(no and 1000 <= no <= 2100)),
            float(n in self.key_of),
        ]

    def possible(self, n: int) -> bool:
        """Whether a line could be furniture at all."""
        return n in self.numbers or len(self.keys.get(self.key_of.get(n, ""), ())) > 1 or (n in self.parts and self.parts[n][1] is not None) or is_title(self.lines[self.at[n]])


def roman(s: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    s = s.lower()
    if not s or any(c not in value for c in s):
        return None
    v = [value[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))


#: How pages are numbered and headed.
NUMBER_FORMS = ("{n}", "— {n} —", "- {n} -", "[{n}]", "· {n} ·", "p. {n}", "S. {n}", "Page {n}", "Seite {n}", "Blatt {n}", "Página {n}", "Pág. {n}", "fol. {n}r", "Fl. {n}", "Page {n} of {k}", "page {n} sur {k}", "{r}", "( {n} )", "Bl. {n}", "f. {n}v")
TITLE_FORMS = (
    "History of the {w} family", "The {w} ledger, second volume", "Letters to {w}", "Memoirs of {w}", "A short description of {w} county", "Die Geschichte der Familie {w}", "Urkunden zur Stadt {w}", "Tagebuch einer Fahrt nach {w}", "Verzeichnis der Güter zu {w}",
    "Mémoires sur {w}", "Histoire de la ville de {w}", "Inventaire des biens de {w}", "Historia de la villa de {w}", "Memorias de {w}", "Cartas a {w}", "História da vila de {w}", "Memórias de {w}", "Inventário dos bens de {w}",
)


def to_roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


def written_page(sentences: list[str], names: list[str], rnd: random.Random) -> tuple[str, dict[str, str]]:
    """A text of pages with or without furniture; line -> ``title``, ``number`` or both."""
    kinds: dict[str, str] = {}
    width = rnd.randint(38, 75)
    title = rnd.choice(TITLE_FORMS).format(w=rnd.choice(names)) if rnd.random() < 0.45 else None
    if title:
        style = rnd.randrange(5)
        title = [title, title.upper(), f"** {title} **", " ".join(title.upper()).replace("     ", "   "), f"{title}  {rnd.randint(1700, 1960)}"][style]
    form = rnd.choice(NUMBER_FORMS) if rnd.random() < 0.45 else None
    first, top, both = rnd.randint(2, 180), rnd.random() < 0.5, rnd.random() < 0.35
    lines = []
    for page in range(rnd.randint(1, 5)):
        body, line = [], ""
        for w in " ".join(rnd.choice(sentences) for _ in range(rnd.randint(2, 6))).split():
            if len(line) + len(w) + 1 > width:
                body.append(line)
                line = w
            else:
                line = f"{line} {w}".strip()
        body.append(line)
        if rnd.random() < 0.25:
            body += ["", *(f"- {' '.join(rnd.choice(sentences).split()[:3])}" for _ in range(rnd.randint(1, 4)))]
        if rnd.random() < 0.08:
            again = [" ".join(rnd.choice(sentences).split()[: rnd.randint(2, 6)]).rstrip(".,") for _ in range(rnd.choice((1, 1, 1, 2, 3)))]
            body += again * rnd.randint(3, 25)
        if rnd.random() < 0.12:
            body += ["", *(f"{rnd.randint(1, 900)}\t{rnd.choice(names)}\t{rnd.randint(1, 30)}.0{rnd.randint(1, 9)}.18{rnd.randint(10, 99)}" for _ in range(3))]
        if rnd.random() < 0.15:
            body = [f"{rnd.choice(names)}, {rnd.randint(1, 28)}.0{rnd.randint(1, 9)}.18{rnd.randint(10, 99)}", "", *body, "", rnd.choice(["Yours faithfully,", "Hochachtungsvoll", "Atentamente,"]), rnd.choice(names)]
        no = first + page
        t, f = title, form and form.format(n=no, k=first + 40, r=to_roman(no))
        if title and form and both:
            t, f = (f"{no}    {title}" if page % 2 == 0 else f"{title}    {no}"), None
            kinds[t] = "both"
        if t:
            t = misread(t, rnd) if rnd.random() < 0.15 else t
            kinds.setdefault(t, kinds.get(t, "title") if "    " not in t else "both")
            body = [t, *body] if top else [*body, t]
        if f:
            kinds[f] = "number"
            body = [f, *body] if rnd.random() < 0.2 else [*body, f]
        lines += [*(["### REGION %d" % (page + 1)] if rnd.random() < 0.5 else [""] * rnd.randint(0, 1)), *body]
    return "\n".join(lines), kinds


class PageModels:
    """Furniture and join classifiers over line pairs."""

    def __init__(self, sample: list[str], vocab: Counter, seed: int = 1):
        rnd = random.Random(seed)
        sentences = sorted({s for t in sample for s in C.sentences(t) if 30 < len(s) < 160 and s[-1] in ".!?" and "\t" not in s and "|" not in s})[:4000] or ["The clerk wrote the letter to the council in the spring."]
        names = sorted({w for s in sentences for w in re.findall(r"(?<=[a-z] )[A-Z][a-z]{4,}", s)})[:300] or ["Haskval"]
        x, t, n = [], [], []
        for _ in range(800):
            text, kinds = written_page(sentences, names, rnd)
            ls = Lines(text)
            for i in range(len(ls.at)):
                if ls.possible(i):
                    k = kinds.get(ls.lines[ls.at[i]], "")
                    x.append(ls.features(i))
                    t.append(k in ("title", "both"))
                    n.append(k in ("number", "both"))
        self.title = Boosted(trees=25, depth=4).fit(np.array(x, float), np.array(t, float))
        self.number = Boosted(trees=25, depth=4).fit(np.array(x, float), np.array(n, float))
        self.vocab = vocab
        x, y = [], []
        plain = [w for w, c in vocab.most_common(2500) if w.isalpha() and len(w) >= 5] or ["council", "letter"]
        hyphened = [w for w, c in vocab.items() if "-" in w and c > 1 and not w.startswith("-") and all(p.isalpha() for p in w.split("-"))] or ["well-known", "post-war"]
        for w in plain:
            i = rnd.randint(2, len(w) - 2)
            a, b = w[:i], w[i:]
            if rnd.random() < 0.15:
                a = misread(a, rnd)
            x.append(self.join_features(a, rnd.choice(HYPHEN + "---"), rnd.random() < 0.85, b))
            y.append(1)
        for _ in range(len(plain)):
            kind = rnd.random()
            if kind < 0.5:
                a, b = rnd.choice(hyphened).split("-")[:2]
                x.append(self.join_features(a, "-", True, b))
            elif kind < 0.85:
                x.append(self.join_features(rnd.choice(plain)[: rnd.randint(3, 9)], "-", rnd.random() < 0.5, rnd.choice(sorted(STOP))))
            else:
                x.append(self.join_features(rnd.choice(plain), "-", False, rnd.choice(plain)))
            y.append(0)
        self.join = Boosted(trees=25, depth=4).fit(np.array(x, float), np.array(y, float))

    def join_features(self, a: str, mark: str, newline: bool, b: str) -> list[float]:
        v, a, b = self.vocab, a.lower().strip(EDGE), b.lower().strip(EDGE)
        return [
            np.log1p(v.get(a + b, 0)), np.log1p(v.get(f"{a}-{b}", 0)), np.log1p(v.get(a, 0)), np.log1p(v.get(b, 0)), float(mark != "-"), float(newline), float(len(a)), float(len(b)), float(b in STOP), float(np.log1p(v.get(a + "-", 0))),
        ]

    def furniture(self, every: list[Lines]) -> list[dict[int, str]]:
        """Per text: line number -> ``title``, ``number`` or ``both``; scored all at once."""
        ask = [(k, n) for k, ls in enumerate(every) for n in range(len(ls.at)) if ls.possible(n)]
        out: list[dict[int, str]] = [{} for _ in every]
        if not ask:
            return out
        x = np.array([every[k].features(n) for k, n in ask], float)
        t, p = self.title.score(x) >= FURNITURE_P, self.number.score(x) >= FURNITURE_P
        for (k, n), a, b in zip(ask, t, p):
            if a or b:
                out[k][n] = "both" if a and b else "title" if a else "number"
        return out

    def joins(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text: (start, end, joined word) of the words that are to be joined."""
        ms = [(k, m) for k, t in enumerate(texts) for m in split_pairs(t) if m.group(4)[0].islower() or m.group(1)[-1:].isupper()]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if ms:
            p = self.join.score(np.array([self.join_features(m.group(1).split("'")[-1], m.group(2), bool(m.group(3)), m.group(4)) for _, m in ms], float))
            for (k, m), q in zip(ms, p):
                if q >= JOIN_P:
                    out[k].append((m.start(), m.end(), m.group(1) + m.group(4)))
        return out


def joined(body: str, js: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for a, b, w in js:
        parts += [body[last:a], w]
        last = b
    return "".join([*parts, body[last:]]) if js else body


def stripped(texts: list[str], models: PageModels) -> list[tuple[Lines, dict[int, str], str]]:
    """Per text its lines, its furniture, and what is left without the furniture."""
    every = [Lines(t) for t in texts]
    out = []
    for ls, kind in zip(every, models.furniture(every)):
        gone = {ls.at[n] for n in kind}
        out.append((ls, kind, "\n".join(x for i, x in enumerate(ls.lines) if i not in gone) if gone else "\n".join(ls.lines)))
    return out


def defects(texts: list[str], models: PageModels, fixes: dict[str, str] | None) -> list[tuple[set[str], list[str]]]:
    """Per text its defects, and the words that remain once its lines are repaired."""
    parts = stripped(texts, models)
    out = []
    for (ls, kind, body), js in zip(parts, models.joins([b for _, _, b in parts])):
        found_: set[str] = set()
        titles: dict[str, list[int]] = {}
        for n, k in kind.items():
            if k in ("title", "both"):
                titles.setdefault(ls.key_of.get(n, ""), []).append(n)
        if any(len(ns) >= 2 for k, ns in titles.items() if k):
            found_.add("header")
        if any(k in ("number", "both") for k in kind.values()):
            found_.add("page_number")
        if js:
            found_.add("hyphenation")
        ws = words(joined(body, js) + ("\n" + "\n".join(ls.lines[ls.at[n]] for n in kind) if kind else ""))
        if fixes is not None and sum(map(fixes.__contains__, ws)) >= MISREAD_WORDS:
            found_.add("misread")
        out.append((found_, ws))
    return out


def repair(texts: list[str | None], models: PageModels, fixes: list[dict[str, str]]) -> list[str]:
    """Continuous paragraphs without furniture, with words joined and letters corrected."""
    parts = stripped([t or "" for t in texts], models)
    return [_flow(joined(body, js), fx) for (_, _, body), js, fx in zip(parts, models.joins([b for _, _, b in parts]), fixes)]


def _flow(body: str, fixes: dict[str, str]) -> str:
    def fix(m: re.Match) -> str:
        raw = m.group(0)
        f = fixes.get(raw.lower())
        if not f:
            return raw
        return f.upper() if raw.isupper() and len(raw) > 1 else f[0].upper() + f[1:] if raw[0].isupper() else f

    out: list[str] = []
    going_on = False
    for p in re.split(r"\n[ \t]*\n", body):
        lines = [x for x in p.split("\n") if x.strip()]
        if not lines:
            continue
        kept = any("\t" in x or x.lstrip().startswith(("|", "- ", "{")) for x in lines)
        flow = "\n".join(x.rstrip() for x in lines) if kept else " ".join(x.strip() for x in lines)
        flow = TOKENS.sub(fix, ACCENT.sub("´", flow)).replace("´", "'")
        #: A paragraph that a page end broke goes on.
        if out and going_on and flow[:1].islower():
            out[-1] += " " + flow
        else:
            out.append(flow)
        going_on = not flow.rstrip().endswith((".", "!", "?", ":", '"'))
    return "\n\n".join(out)


def in_parts(pdf: pd.DataFrame, size: int = 400) -> Iterator[pd.DataFrame]:
    return (pdf.iloc[a : a + size] for a in range(0, len(pdf), size))


# ---------------------------------------------------------------- queries


class Shipped:
    """Corrections and models as the Python workers need them."""

    def __init__(self, results: DataFrame, sample_rows: int = SAMPLE_ROWS):
        spark = results.sparkSession
        self.texts = both_fields(results)
        self.counts = C.cut(word_counts(self.texts))
        self.fixes = C.cut(in_company(self.texts, C.cut(corrections(self.counts, fit_replacements(self._vocab(2000))))))
        sample = C.sample_texts(results, "extracted_text", sample_rows)
        self.models = spark.sparkContext.broadcast(PageModels(sample, self._lexicon()))

    def _vocab(self, n: int) -> Counter:
        """The most frequent plain words; as a lexicon for joins its size is bounded by n."""
        rows = self.counts.where((F.col("n") >= 3) & F.col("word").rlike(r"^[\p{L}'’-]+$")).orderBy(F.desc("n"), "word").limit(n).collect()
        return Counter({r[0]: r[1] for r in rows})


    def _lexicon(self) -> Counter:
        """All words that stand three times or more and are at least one of ``LEXICON_SHARE`` words.

        There can be at most ``LEXICON_SHARE`` of them however large the table is, and far fewer
        by the law of word frequencies; a rarer word says as little about a join as an unknown one.
        """
        total = self.counts.agg(F.sum("n")).first()[0] or 0
        rows = self.counts.where((F.col("n") >= 3) & (F.col("n") >= total / LEXICON_SHARE) & F.col("word").rlike(r"^[\p{L}'’-]+$")).collect()
        return Counter({r[0]: r[1] for r in sorted(rows)})


def found_in(results: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(job_id, file_index, fld, defect)."""
    s = Shipped(results, sample_rows)
    models, spark = s.models, results.sparkSession
    schema = "job_id string, file_index int, fld string, defect string"
    if s.fixes.count() <= BROADCAST_WORDS:
        fixes = spark.sparkContext.broadcast({r[0]: r[1] for r in s.fixes.select("word", "fix").collect()})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(j, f, c, d) for x in in_parts(pdf) for j, f, c, (ds, _) in zip(x["job_id"], x["file_index"], x["fld"], defects(list(x["text"]), models.value, fixes.value)) for d in ds]
            return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "defect"])

        return C.map_texts(s.texts, schema, run).distinct()

    def lines(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for j, f, c, (ds, ws) in [r for x in in_parts(pdf) for r in zip(x["job_id"], x["file_index"], x["fld"], defects(list(x["text"]), models.value, None))]:
            rows += [(j, f, c, d, None, 0) for d in ds]
            rows += [(j, f, c, None, w, n) for w, n in Counter(ws).items() if is_word(w)]
        return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "defect", "word", "k"])

    every = C.map_texts(s.texts.distinct(), schema + ", word string, k long", lines)
    per = every.where("word is not null").join(s.fixes.select("word"), "word").groupBy("job_id", "file_index", "fld").agg(F.sum("k").alias("k"))
    wrong = per.where(F.col("k") >= MISREAD_WORDS).select("job_id", "file_index", "fld", F.lit("misread").alias("defect"))
    return every.where("defect is not null").select("job_id", "file_index", "fld", "defect").unionByName(wrong).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(C.table(spark, sf_dir, "results"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, file_index, fld, clean_text) of every stored text.

    Where there are more corrections than may be broadcast, each worker takes those of
    its own words by a join before the repair.
    """
    s = Shipped(C.table(spark, sf_dir, "results"))
    models = s.models
    schema = "job_id string, file_index int, fld string, clean_text string"
    if s.fixes.count() <= BROADCAST_WORDS:
        fixes = spark.sparkContext.broadcast({r[0]: r[1] for r in s.fixes.select("word", "fix").collect()})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf.assign(clean_text=[r for x in in_parts(pdf) for r in repair(list(x["text"]), models.value, [fixes.value] * len(x))])[["job_id", "file_index", "fld", "clean_text"]]

        return C.map_texts(s.texts, schema, run).distinct()

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(j, f, c, w) for x in in_parts(pdf) for j, f, c, (_, ws) in zip(x["job_id"], x["file_index"], x["fld"], defects(list(x["text"]), models.value, None)) for w in set(ws)]
        return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "word"])

    texts = s.texts.distinct()
    key = ["job_id", "file_index", "fld"]
    mine = C.map_texts(texts, "job_id string, file_index int, fld string, word string", own).join(s.fixes, "word").groupBy(*key).agg(F.collect_set(F.struct("word", "fix")).alias("pairs"))

    def with_own(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(clean_text=repair(list(pdf["text"]), models.value, [{p["word"]: p["fix"] for p in (ps if ps is not None else ())} for ps in pdf["pairs"]]))[["job_id", "file_index", "fld", "clean_text"]]

    return C.map_texts(texts.join(mine, key, "left"), schema, with_own)


QUERIES = {"p1_found": found, "p1_repaired": repaired}
