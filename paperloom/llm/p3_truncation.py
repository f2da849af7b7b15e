"""Values that lost their end at a field limit or in transfer (problem 3).

Method: one stack automaton walks over a whole text and keeps what is open: markup, code
fences, JSON with its strings and escapes, and, within a paragraph, brackets and quotes of
all kinds. What it holds at the end, and broken multibyte sequences, escapes and marks at
the end itself, give the text's structure: ``broken``, ``open`` or ``closed``. After running titles
and page numbers are taken off, the last passage has a shape (``SHAPES``) and ends with a terminator or
not. Whether a missing terminator means a loss is a matter of the source's baseline: the
share of its texts of that shape that end with one, counted over all texts. Where texts
of the shape usually end without, a value is only a case if the automaton holds
something, or if its length is a field limit of the source: a length at which the
source's other cases pile up. Sources are ``jobs.model_version`` for extracted texts
and ``translation_requests.model`` for translations.

Cases: null, empty and blank values are complete; values with residue of problem 6
are no cases; very long values are walked once, in linear time; repeated rows give
one result; a limit needs ``LIMIT_SHARE`` of the source's cases and at least
two of them; a source with few texts leans on ``PRIOR``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import p6_residue

LIMIT_SHARE = 0.03
#: From this share of terminated endings on, a missing terminator is a loss.
BASELINE = 0.5
#: Texts with and without a terminator that every source's shape starts from: (with, without).
PRIOR = {"prose": (8.0, 2.0), "long_item": (4.0, 1.0)}
PRIOR_OTHER = (1.0, 4.0)
SHAPES = ("prose", "long_item", "item", "row", "cells", "field", "heading", "title", "number", "closing", "colon")
CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“„", "“": "„", "’": "‘"}
EVENTS = re.compile(r"```|\n[ \t\r\f\v\xa0]*\n|</?[A-Za-z][\w\-]*(?:\s[^<>\n]*)?/?>|[()\[\]{}«»“”„\"]")
VOID = frozenset("br hr img meta link input source col wbr".split())
TWO_SIGNS = re.compile(r"[^\W_][\W_]*[^\W_]")
#: No match is longer than eight characters.
BROKEN = re.compile(r"(?:�|\\|\\u[0-9a-fA-F]{0,3}|&(?:[a-z]{2,6}|#\d{0,4})|[\ud800-\udfff])$")
TERMINATED = re.compile(r"[.!?。！？:](?:[\"'»“”’)\]*_]*)$")
ELLIPSIS = re.compile(r"(?:…|\.\.\.)[\"'»”’)]*$")
NUMERAL = r"(?:\d{1,5}[rv]?|[ivxlcdm]{1,8})"
PAGE_NO = re.compile(
    rf"^[\W_]*(?:(?:page|seite|página|pagina|blatt|s|p|pp|pg|pág|fol|fl|f|bl|no|nr|feuille|hoja|folha|sheet|leaf)\b[. ]*)?{NUMERAL}(?:\s*(?:of|sur|von|de|/|\|)\s*\d{{1,5}})?[\W_]*$",
    re.I,
)
DATE = re.compile(r"^[\w .'\-]{0,40},?\s*(?:\d{1,2}[./]\s?\d{1,2}[./]\s?\d{2,4}|\d{1,2}\.? [^\W\d_]+ \d{4})\.?$")
ITEM = re.compile(r"^\s*(?:[-•*–]\s|\d{1,3}[.)]\s)")
FIELD = re.compile(r"^[^\W\d_][\w .\-]{1,24}:\s*\S")
#: The closing formulas of letters.
CLOSINGS = (
    "yours faithfully", "yours sincerely", "with kind regards", "kind regards", "your obedient servant", "respectfully",
    "mit freundlichen grüßen", "hochachtungsvoll", "ihr ergebener", "ihre ergebene", "mit vorzüglicher hochachtung",
    "veuillez agréer mes salutations distinguées", "bien à vous", "cordialement", "votre dévoué",
    "atentamente", "su seguro servidor", "un cordial saludo", "saludos cordiales",
    "com os melhores cumprimentos", "atenciosamente", "cordialmente", "respeitosamente",
)
HEADER = re.compile(r"^(?:#+ REGION \d+|## Extracted by \S+ \(Ollama\))\s*$")
HEADER_TAIL = re.compile(r"(?:^|\n)(##[^\n]*)\s*\Z")
CLOSING = re.compile(r"(?:^|[\n.!?]\s*)(?:" + "|".join(re.escape(c) for c in CLOSINGS) + r"),?(?:\s+[A-ZÀ-Þ][\w.'\-]*){0,4}\s*$", re.I)


class Letters(dict):
    """For ``str.translate``: capitals become ``U``, other letters ``l``, all else goes."""

    def __missing__(self, c: int) -> str | None:
        self[c] = m = ("U" if chr(c).isupper() else "l") if chr(c).isalpha() else None
        return m


LETTERS = Letters()
SPACED_TITLE = re.compile(r"(?:[^\W_]\s){4,}")
NUMBER_BEHIND = re.compile(r"\s{2,}\d{1,5}$")
NUMBER_BEFORE = re.compile(r"\d{1,5}\s{2,}\S")


@lru_cache(4096)
def is_title(line: str) -> bool:
    """Lines in the form of a running title: starred, spaced out or in capitals.

    The last lines are kept, since a page's text and its regions hold the same ones.
    """
    s = line.strip()
    if not s or len(s) > 80:
        return False
    if s.startswith("**") and s.endswith("**"):
        return True
    letters = s.translate(LETTERS)
    if len(letters) >= 6 and letters.count("U") >= 0.75 * len(letters):
        return True
    return bool(SPACED_TITLE.match(s)) or ((line[-1].isdecimal() or line[-1] == "\n") and bool(NUMBER_BEHIND.search(line))) or bool(NUMBER_BEFORE.match(line))


def walk(text: str) -> list[str]:
    """What the stack automaton holds after the text.

    A text that begins as JSON is read as JSON: brackets, strings and escapes. Elsewhere
    markup and code fences stay open over paragraphs; inside a fence nothing else counts;
    brackets and quotes end with their paragraph, since a page quotes freely.
    """
    if re.match(r'^[{\[]\s*(?:"|\{|$)', text):
        stack: list[str] = []
        for c in re.findall(r'[\[\]{}"]|\\.?|[^\[\]{}"\\]+', text, re.S):
            inside = bool(stack) and stack[-1] == '"'
            if c == "\\":
                stack.append(c)
            elif c == '"':
                stack.pop() if inside else stack.append(c)
            elif not inside and c in "[{":
                stack.append(c)
            elif not inside and c in "]}" and stack:
                stack.pop()
        return stack
    outer: list[str] = []
    inner: list[str] = []
    for m in EVENTS.finditer(text):
        c = m.group(0)
        if c == "```":
            outer.pop() if outer and outer[-1] == c else outer.append(c)
            inner = []
        elif outer and outer[-1] == "```":
            continue
        elif c[0] == "\n":
            inner = []
        elif c[0] == "<":
            name = re.match(r"</?([\w\-]+)", c).group(1).lower()
            if c[1] == "/":
                if "<" + name in outer:
                    del outer[len(outer) - 1 - outer[::-1].index("<" + name) :]
            elif not c.endswith("/>") and name not in VOID:
                outer.append("<" + name)
        elif c == '"' or (c in CLOSES and inner and inner[-1] in CLOSES[c]):
            if inner and (inner[-1] == c or (c in CLOSES and inner[-1] in CLOSES[c])):
                inner.pop()
            elif c == '"':
                inner.append(c)
        elif c not in CLOSES or c == "“":
            inner.append(c)
    return outer + inner


def tail_of(text: str | None) -> tuple[str, str, bool]:
    """(structure, shape, terminated) of a text's end; see the module's text."""
    done = ("closed", "closing", True)
    if text and (m := HEADER_TAIL.search(text)) and not HEADER.match(m.group(1)):
        return "broken", "prose", False
    tail = C.content(text).strip()
    if not TWO_SIGNS.search(tail):
        return done
    stack = walk(tail)
    if BROKEN.search(tail[-8:]) or re.search(r"<[^<>\s][^<>\n]*$", tail):
        return "broken", "prose", False
    if tail[0] in "{[" and re.match(r'^[{\[]\s*(?:"|\{|$)', tail):
        return ("broken", "prose", False) if stack else done
    if any(x[0] in "`<" for x in stack):
        return "broken", "prose", False
    structure = "open" if stack else "closed"
    if tail.endswith(">"):
        tail = re.sub(r"(?:\s*</[A-Za-z][\w\-]*>)+$", "", tail)
    raw = tail.split("\n")
    lines = [x.rstrip() for x in raw if x.strip()]
    if not lines:
        return done
    fresh = [i == 0 or not raw[i - 1].strip() for i, x in enumerate(raw) if x.strip()]
    width = max(map(len, lines))
    count: dict[str, int] = {}
    for x in lines:
        k = re.sub(r"[\W\d_]+", "", x).lower()
        count[k] = count.get(k, 0) + 1
    while len(lines) > 1:
        last = lines[-1]
        k = re.sub(r"[\W\d_]+", "", last).lower()
        cells = "\t" in last or "|" in last
        if ITEM.match(last) and ITEM.match(lines[-2]):
            break
        number = PAGE_NO.match(last.strip()) and not re.match(r"^\d+\.$", last.strip()) and not cells
        again = count[k] > 1 and len(k) > 5 and not TERMINATED.search(last) and not cells and not ITEM.match(last)
        if not (number or is_title(last) or again):
            break
        lines.pop()
    last = lines[-1].strip()
    words = last.split()
    ended = bool(TERMINATED.search(last))
    if last.startswith("<"):
        return structure, "closing", True
    if "\t" in last or last.startswith("|"):
        sep = "\t" if "\t" in last else "|"
        before = [x.count(sep) for x in lines[:-1] if sep in x]
        short = (before and last.count(sep) < max(before[-3:])) or (sep == "|" and not last.endswith("|"))
        return ("broken" if short else structure), "cells" if short else "row", False
    if DATE.match(last) or CLOSING.search("\n".join(lines[-2:])) or CLOSING.search(last):
        return structure, "closing", ended
    if len(lines) > 1 and len(words) <= 4 and last[0].isupper() and lines[-2].endswith(",") and len(lines[-2].split()) <= 6 and not ended:
        return structure, "closing", False
    if ELLIPSIS.search(last):
        return "broken", "prose", False
    if ended and last.endswith(":") and len(words) > 3:
        return structure, "colon", False
    if is_title(lines[-1]):
        return structure, "title", ended
    #: A short line right below a finished line that had room for it is a running title.
    if not ended and len(lines) > 1 and not fresh[len(lines) - 1] and len(words) <= 7 and TERMINATED.search(lines[-2]) and len(lines[-2]) + 1 + len(words[0]) <= width and len(last) < 0.9 * width and last[0].isupper():
        return structure, "closing", False
    loose = last.endswith((",", ";"))
    if ITEM.match(last):
        return structure, "item" if len(words) <= 7 and not loose else "long_item", ended
    if FIELD.match(last) and len(last) < 60 and not loose:
        return structure, "field", ended
    if len(lines) == 1 and len(words) <= 7 and last[0].isupper() and not loose:
        return structure, "heading", ended
    if re.search(r"\d$", last) and len(words) <= 4:
        return structure, "number", ended
    return structure, "prose", ended


def judged(structure: str, terminated: bool, usual: float) -> str:
    """``complete``, ``cut`` or ``open`` (a case only at a limit) where ``usual`` of such texts end with a terminator."""
    if structure == "broken":
        return "cut"
    if terminated:
        return "open" if structure == "open" else "complete"
    return "cut" if structure == "open" or usual >= BASELINE else "open"


def ending(text: str | None) -> str:
    """How a text ends by the baseline of a source without texts of its own."""
    structure, shape, terminated = tail_of(text)
    a, b = PRIOR.get(shape, PRIOR_OTHER)
    return "complete" if shape == "closing" and structure != "broken" else judged(structure, terminated, a / (a + b))


def endings(results: DataFrame, jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """(job_id, file_index, fld, source, n_chars, n_bytes, structure, shape, terminated): one row per text and source.

    Sources of a field are small tables of keys; texts meet them before the Python
    stage only by their keys, and leave it as short rows.
    """
    index = results.sparkSession.sparkContext.broadcast(p6_residue.index_for(results))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ix = index.value
        rows = []
        for j, f, c, t in zip(pdf["job_id"], pdf["file_index"], pdf["fld"], pdf["text"]):
            structure, shape, ended = tail_of(t)
            if (structure != "closed" or not ended) and shape != "closing" and ix.kinds(t):
                structure, shape, ended = "closed", "closing", True
            rows.append((j, f, c, len(t), len(t.encode("utf-8", "replace")), structure, shape, ended))
        return pd.DataFrame(rows, columns=["job_id", "file_index", "fld", "n_chars", "n_bytes", "structure", "shape", "terminated"])

    e = C.map_texts(C.fields(results), "job_id string, file_index int, fld string, n_chars int, n_bytes int, structure string, shape string, terminated boolean", run)
    e = C.cut(e.distinct())
    by_job = jobs.select("job_id", F.col("model_version").alias("source")).distinct()
    by_key = requests.select("job_id", F.col("file_index").cast("int").alias("file_index"), F.col("model").alias("source")).distinct()
    return (
        e.where("fld = 'extracted_text'").join(by_job, "job_id", "left").unionByName(e.where("fld = 'translation'").join(by_key, ["job_id", "file_index"], "left"))
    ).withColumn("source", F.coalesce("source", F.lit("unknown")))


def truncated(e: DataFrame) -> DataFrame:
    """Adds ``ending`` and ``truncated`` by the source's baselines: usual terminators, and limits where its cases pile up.

    Both are one small table by source, counted once over all texts: at most a row per
    source and shape, and ``1 / LIMIT_SHARE`` limits of either unit.
    """
    a = F.coalesce(*[F.when(F.col("shape") == k, F.lit(v[0])) for k, v in PRIOR.items()], F.lit(PRIOR_OTHER[0]))
    b = F.coalesce(*[F.when(F.col("shape") == k, F.lit(v[1])) for k, v in PRIOR.items()], F.lit(PRIOR_OTHER[1]))
    usual = e.where("structure = 'closed'").groupBy("fld", "source", "shape").agg(F.count_if("terminated").alias("with"), F.count_if(~F.col("terminated")).alias("without"))
    usual = usual.select("fld", "source", "shape", ((F.col("with") + a) / (F.col("with") + F.col("without") + a + b)).alias("usual"))
    e = e.join(F.broadcast(usual), ["fld", "source", "shape"], "left").withColumn("usual", F.coalesce("usual", a / (a + b)))
    lost = ~F.col("terminated") & ((F.col("structure") == "open") | (F.col("usual") >= BASELINE))
    closing = (F.col("shape") == "closing") & (F.col("structure") != "broken")
    kind = F.when(closing, "complete").when((F.col("structure") == "broken") | lost, "cut").when(F.col("terminated") & (F.col("structure") == "closed"), "complete").otherwise("open")
    e = C.cut(e.withColumn("ending", kind).drop("usual"))
    unit = F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("n_chars").alias("n")), F.struct(F.lit("b").alias("unit"), F.col("n_bytes").alias("n")))).alias("x")
    per = e.where("ending = 'cut'").select("fld", "source", unit).groupBy("fld", "source", "x.unit", "x.n").agg(F.count("*").alias("k"))
    total = e.where("ending = 'cut'").groupBy("fld", "source").agg(F.count("*").alias("total"))
    limits = per.join(F.broadcast(total), ["fld", "source"]).where((F.col("k") >= 2) & (F.col("k") >= LIMIT_SHARE * F.col("total")))
    limits = limits.groupBy("fld", "source").agg(F.collect_set(F.when(F.col("unit") == "c", F.col("n"))).alias("at_c"), F.collect_set(F.when(F.col("unit") == "b", F.col("n"))).alias("at_b"))
    at = F.coalesce(F.array_contains("at_c", F.col("n_chars")), F.lit(False)) | F.coalesce(F.array_contains("at_b", F.col("n_bytes")), F.lit(False))
    return e.join(F.broadcast(limits), ["fld", "source"], "left").withColumn("truncated", (F.col("ending") == "cut") | ((F.col("ending") == "open") & at)).drop("at_c", "at_b")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: C.table(spark, sf_dir, n)
    return truncated(endings(t("results"), t("jobs"), t("translation_requests")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).where("truncated").select("job_id", "file_index", "fld").distinct()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fld, source, n_texts, n_truncated, rate) over all stored texts."""
    one = _all(spark, sf_dir).groupBy("fld", "source", "job_id", "file_index").agg(F.max(F.col("truncated").cast("int")).alias("t"))
    return (
        one.groupBy("fld", "source")
        .agg(F.count("*").alias("n_texts"), F.sum("t").cast("bigint").alias("n_truncated"))
        .withColumn("rate", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
    )


QUERIES = {"p3_found": found, "p3_rates": rates}
