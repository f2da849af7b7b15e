"""The text operators on hand-made cases and small tables."""

import itertools
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import schema
from paperloom.llm import abuse_sentences, exemplars, langdata
from paperloom.llm import common as C
from paperloom.llm import p1_scan_noise as p1
from paperloom.llm import p2_language as p2
from paperloom.llm import p3_truncation as p3
from paperloom.llm import p4_pairs as p4
from paperloom.llm import p5_repetition as p5
from paperloom.llm import p6_residue as p6
from paperloom.llm import p7_alignment as p7
from paperloom.llm import p8_encoding as p8
from paperloom.llm import p9_packing as p9
from paperloom.llm import p10_abuse as p10
from paperloom.llm import queries as Q

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, job_id STRING, created_at TIMESTAMP"
LABELS = "job_id STRING, file_index INT, fld STRING, lang STRING"
ALIGN = "job_id STRING, file_index INT"
WHO = {"en": ["The clerk", "The printer", "The widow", "The gardener"], "de": ["Der Schreiber", "Der Drucker", "Die Witwe", "Die Gärtnerin"]}
DID = {"en": ["signed", "lost", "found", "sold"], "de": ["unterschrieb", "verlor", "fand", "verkaufte"]}
WHAT = {"en": ["the letter", "the register", "the old map", "the bridge plan"], "de": ["den Brief", "das Register", "die alte Karte", "den Brückenplan"]}


def sentence(lang, i, j, k, year):
    tail = {"en": f"in the winter of {year}.", "de": f"im Winter {year}."}[lang]
    return f"{WHO[lang][i]} {DID[lang][j]} {WHAT[lang][k]} {tail}"


def triples(n, seed):
    rnd = random.Random(seed)
    return [(rnd.randrange(4), rnd.randrange(4), rnd.randrange(4), 1700 + rnd.randrange(200)) for _ in range(n)]


def small_tables(spark, folder):
    """A little of everything, with nulls, blanks, repeats, long texts and extra columns of clashing names."""
    res, labels, requests, align = [], [], [], []
    for n in range(40):
        t = triples(5, n)
        en, de = " ".join(sentence("en", *x) for x in t), " ".join(sentence("de", *x) for x in t)
        res.append(("j%d" % (n % 3), n, f"f{n}.png", {"1": en, "2": ""}, en, de, None if n % 5 == 0 else False))
        labels.append(("j%d" % (n % 3), n, "extracted_text", [None, "eng", "de", " "][n % 4]))
        requests.append(("j%d" % (n % 3), n, "tr", "German", None, None))
        align.append(("j%d" % (n % 3), n))
    long = " ".join(sentence("en", *x) for x in triples(600, 9))
    res += [("j0", 100, None, None, None, None, None), ("j0", 101, "x", {}, "", "   ", False), ("j0", 102, "x", {"1": None}, long, "Sorry, I cannot fulfil that request.", True), ("j0", 103, "y", None, "�", "…", None), (None, None, None, None, "a", "b", None)]
    res.append(res[0])
    requests += [("j0", 101, "tr", "German", "Casual", None), ("j0", 102, "tr", "German", None, None), ("j9", 1, None, None, None, None), requests[0]]
    labels += [("j0", 101, "extracted_text", None), ("j9", 3, None, None), labels[0]]
    align += [("j0", 101), ("j0", 100), (None, None)]
    docs = [(i, sentence("en", *x), "en", "s%d" % (i % 2), 1, None, None) for i, x in enumerate(triples(60, 3))]
    docs += [(i + 100, sentence("de", *x), "de", "s0", 1, None, None) for i, x in enumerate(triples(60, 4))]
    docs += [(300, None, None, None, None, None, None), (301, "", "de", "s1", 0, None, None), (302, "  \n\t", None, "s1", 4, None, None), (303, long, "en", "s1", 9, None, None), (304, docs[0][1], "en", "s1", 1, None, None), (305, "Go to hell, you worthless moron!", "en", "s1", 1, None, None)]
    extra = lambda df: df.selectExpr("*", "1 AS text2", "'x' AS fld2", "2 AS word", "3 AS n_tokens", "'q' AS category", "4 AS score", "5 AS p")
    write = lambda df, n: df.write.parquet(os.path.join(folder, f"{n}.parquet"))
    write(extra(spark.createDataFrame(res, schema.RESULTS)).selectExpr("*", "'c' AS text", "'d' AS lang", "'e' AS source"), "results")
    write(spark.createDataFrame([("j0", None, "q", 1, "m", "", 0.5, []), ("j0", None, "q", 1, "m", "", 0.5, []), ("j1", "n", "q", 1, None, None, None, None)], schema.JOBS), "jobs")
    write(spark.createDataFrame(labels, LABELS).selectExpr("*", "'z' AS label", "'y' AS code", "'x' AS main"), "lang_labels")
    write(spark.createDataFrame(requests, schema.TRANSLATION_REQUESTS).selectExpr("*", "'z' AS target", "'y' AS source"), "translation_requests")
    write(spark.createDataFrame(align, ALIGN), "align_requests")
    write(extra(spark.createDataFrame(docs, DOCUMENTS)).selectExpr("*", "array(1) AS ids"), "documents")
    write(spark.createDataFrame([(64,), (64,), (16,), (None,), (0,)], "capacity_tokens INT"), "pack_sizes")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    small_tables(spark, d)
    return d


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for n, s in (("results", schema.RESULTS), ("jobs", schema.JOBS), ("lang_labels", LABELS), ("translation_requests", schema.TRANSLATION_REQUESTS), ("align_requests", ALIGN), ("documents", DOCUMENTS), ("pack_sizes", "capacity_tokens INT")):
        spark.createDataFrame([], s).write.parquet(os.path.join(d, f"{n}.parquet"))
    return d


COLUMNS = {
    "p1_found": ["job_id", "file_index", "fld", "defect"], "p2_found": ["job_id", "file_index", "fld", "issue", "lang"], "p3_found": ["job_id", "file_index", "fld"], "p4_found": ["job_id", "file_index", "defect"],
    "p5_found": ["job_id", "file_index"], "p6_found": ["job_id", "file_index", "fld", "kind"], "p7_found": ["job_id", "file_index", "src_no", "tgt_no"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "category"],
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_every_query_on_small_and_empty_tables(spark, folder, empty_folder, name):
    df = Q.queries()[name](spark, folder)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p8_ids":
            assert len(rows) == len(set(rows))
    assert Q.queries()[name](spark, empty_folder).count() == 0


def test_small_table_results(spark, folder):
    q = Q.queries()
    four = {(r.job_id, r.file_index): r.defect for r in q["p4_found"](spark, folder).collect()}
    assert four == {("j0", 101): "empty", ("j0", 102): "refusal"}
    two = {(r.file_index, r.issue, r.lang) for r in q["p2_found"](spark, folder).collect()}
    assert two == {(n, "missing" if n % 4 in (0, 3) else "wrong", "en") for n in range(40) if n % 4 != 1}
    three = {(r.file_index, r.fld) for r in q["p3_found"](spark, folder).collect()}
    assert three == set()
    assert {(r.doc_id, r.category) for r in q["p10_found"](spark, folder).collect()} == {(305, "abusive")}
    seven = q["p7_found"](spark, folder).collect()
    right = sum(r.src_no == r.tgt_no for r in seven)
    assert right >= 0.9 * 200 and right >= 0.9 * len(seven)


# ---------------------------------------------------------------- 1


def test_scan_noise_is_found_and_repaired(spark):
    rnd = random.Random(4)
    names = ["signed", "register", "bridge", "council", "harvest", "winter", "letter", "account", "gardener", "photograph", "restored", "boundary", "chapel", "second", "flood"]
    page = lambda: [f"The {rnd.choice(names)} {rnd.choice(names)} the {rnd.choice(names)} near the {rnd.choice(names)} in {1700 + rnd.randrange(200)}." for _ in range(6)]
    rows = [("j", i, "f", {}, " ".join(page()), "", False) for i in range(300)]
    dirty = []
    for n, bad in ((12, "brid9e"), (13, "gardcner"), (14, "accourit")):
        ls = page()
        dirty.append(f"### REGION {n - 11}\n## Extracted by m (Ollama)\n\nREGISTER OF HASKVAL\n" + "\n".join([ls[0], f"The c0uncil and the 1etter and the {bad} and the wint-", "er had a photogr@ph.", ls[1]]) + f"\n— {n} —\n")
    rows.append(("j", 900, "f", {"1": dirty[0], "2": dirty[1], "10": None}, "\n\n".join(dirty), "", False))
    r = spark.createDataFrame(rows, schema.RESULTS)
    got = {(x.file_index, x.fld, x.defect) for x in p1.found_in(r).collect()}
    want = {(900, f, d) for f in ("extracted_text", "regions") for d in ("hyphenation", "misread", "header", "page_number")}
    assert got == want
    s = p1.Shipped(r)
    fixes = {x.word: x.fix for x in s.fixes.collect()}
    assert fixes["c0uncil"] == "council" and fixes["photogr@ph"] == "photograph"
    clean = p1.repair(["\n\n".join(dirty), None, " "], s.models.value, [fixes] * 3)
    assert clean[1:] == ["", ""] and "HASKVAL" not in clean[0] and "—" not in clean[0]
    assert all(f"The council and the letter and the {w} and the winter had a photograph." in clean[0] for w in ("bridge", "gardener", "account"))


def test_ways_beyond_the_broadcast_bounds_agree(spark, folder, monkeypatch):
    q = Q.queries()
    noise = [("j", i, "f", {"1": "x"}, "The council signed the register near the bridge in the winter.", "", False) for i in range(60)]
    noise.append(("j", 99, "f", {"1": "The c0uncil and the reg1ster and the br1dge."}, "The c0uncil and the reg1ster and the br1dge.\nthe win-\nter", "", False))
    r = spark.createDataFrame(noise, schema.RESULTS)
    want = {tuple(x) for x in p1.found_in(r).collect()}
    seven = {tuple(x) for x in q["p7_found"](spark, folder).collect()}
    monkeypatch.setattr(p1, "BROADCAST_WORDS", -1)
    monkeypatch.setattr(p7, "BROADCAST_ROWS", -1)
    assert {tuple(x) for x in p1.found_in(r).collect()} == want and ("j", 99, "regions", "misread") in want and ("j", 99, "extracted_text", "hyphenation") in want
    assert {tuple(x) for x in q["p7_found"](spark, folder).collect()} == seven
    r.write.mode("overwrite").parquet(os.path.join(folder, "noise", "results.parquet"))
    clean = {(x.file_index, x.fld): x.clean_text for x in q["p1_repaired"](spark, os.path.join(folder, "noise")).collect()}
    assert clean[99, "extracted_text"] == "The council and the register and the bridge. the winter"


@pytest.mark.parametrize("times", [1, 5])
@pytest.mark.parametrize("bound", [10**6, -1])
def test_repeated_misreading_is_found_at_any_size(spark, monkeypatch, times, bound):
    monkeypatch.setattr(p1, "BROADCAST_WORDS", bound)
    clean = ["The council signed the register near the bridge in winter."] * 80 + ["The weil stood near the bridge."] * 60 + ["The well stood near the bridge."] * 3
    dirty = ["The c0uncil of the regist3r near the bridqe in wintcr."]
    rows = [("j", i, "f", {}, t, "", False) for i, t in enumerate((clean + dirty) * times)]
    fixes = {x.word: x.fix for x in p1.Shipped(spark.createDataFrame(rows, schema.RESULTS)).fixes.collect()}
    assert fixes["wintcr"] == "winter" and fixes["bridqe"] == "bridge" and "well" not in fixes


def test_facts_of_lines_are_found_once_and_as_defined():
    """A page's text and its regions hold the same lines; quick ways give what the definitions give."""
    page = "\n".join([*(f"{sentence('en', *x)[:-1]}" for x in triples(40, 1)), "REGISTER OF HASKVAL", "REG1STER OF HASKVAL", "12   Register of Haskval"])
    p1.title_key.cache_clear()
    p3.is_title.cache_clear()
    a, b = p1.Lines(page), p1.Lines("### REGION 1\n" + page)
    assert a.keys == b.keys and [a.possible(n) for n in range(len(a.at))] == [b.possible(n) for n in range(len(b.at))]
    assert p1.title_key.cache_info().misses == len({p1.beside(x)[0] for x in a.lines}) and p3.is_title.cache_info().misses <= len(set(a.lines))
    rnd = random.Random(3)
    signs = ["A", "B", "é", "É", "ß", "ﬁ", "ii", "rn", "h", "7", "1", "_", " ", "  ", "\n", "!", "'", "ä", "o", "-", "-", "¬", "\xad", "\t", "\xa0", "**", "٣"]

    def title(line):
        s = line.strip()
        up = [c for c in s if c.isalpha()]
        if not s or len(s) > 80:
            return False
        return (s.startswith("**") and s.endswith("**")) or (len(up) >= 6 and sum(c.isupper() for c in up) >= 0.75 * len(up)) or any(re.search(r, x) for r, x in ((r"^(?:[^\W_]\s){4,}", s), (r"\s{2,}\d{1,5}$", line), (r"^\d{1,5}\s{2,}\S", line)))

    for _ in range(6000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(16)))
        assert p3.is_title(t) == bool(title(t)), t
        assert [m.groups() for m in p1.split_pairs(t)] == [m.groups() for m in p1.PAIR.finditer(t)], t
        assert p1.words(t) == [w for w in p1.TOKENS.findall(re.sub(r"!+(?=\s|$)", " ", re.sub(r"(?<=[aoAO])'(?=[a-zäöüß])", "´", t.lower()))) if w[-1] not in p1.HYPHEN], t
        k = re.sub(r"[\W_]+", "", t.lower().translate(p1.ALIKE).replace("ii", "u").replace("ü", "u"))
        assert p1.title_key(t) == re.sub(r"[il]", "l", k.replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("h", "b")), t


def test_near_title_keys_against_all_pairs():
    """The index of pieces leaves no near key out that shares a piece at the same number."""
    rnd = random.Random(5)
    for _ in range(200):
        stems = ["".join(rnd.choice("abd") for _ in range(rnd.randint(8, 20))) for _ in range(4)]
        keys = {s[:i] + rnd.choice("abd") + s[i + 1 :]: None for s in stems for i in rnd.sample(range(len(s)), 3)}
        got, want = p1.Lines(""), {k: [n] * rnd.randint(1, 3) for n, k in enumerate(keys)}
        got.keys = {k: list(v) for k, v in want.items()}
        got._merge_near_keys()
        parts = lambda k: {(i, k[i * (len(k) // m) : (i + 1) * (len(k) // m)]) for m in [max(2, len(k) // 6) + 1] for i in range(m)}
        for k in sorted(keys, key=lambda k: (len(want[k]), k)):
            near = [o for o in want if o != k and abs(len(o) - len(k)) <= 1 and len(want[o]) >= len(want[k]) and parts(o) & parts(k) and sum(a != b for a, b in zip(o, k)) <= max(2, len(k) // 6)]
            if near:
                o = min(near, key=lambda o: (-len(want[o]), o))
                want[o] = sorted(want[o] + want.pop(k))
        assert got.keys == want


def test_spelled_hyphens_stay(spark):
    vocab = p1.Counter({w: 50 for w in ("known", "well-known", "ein", "und", "register", "council", "winter", "garden")})
    m = p1.PageModels(["The council signed the register in the winter of the year. " * 3], vocab)
    a, b, c = m.joins(["a well-\nknown fair and Ein- und Ausgang", "the win-\nter", "the coun¬ \ncil"])
    assert a == [] and [x[2] for x in b] == ["winter"] and [x[2] for x in c] == ["council"]


def test_candidates_against_brute_force(spark):
    words = [("council", 500), ("letter", 300), ("c0uncil", 2), ("lettcr", 1), ("ietter", 3), ("der", 900), ("dcr", 2), ("counsel", 400)]
    df = spark.createDataFrame(words, "word string, n long")
    got = {(r.word, r.cand) for r in p1.candidates(df).collect()}
    for w, c in (("c0uncil", "council"), ("lettcr", "letter"), ("ietter", "letter"), ("dcr", "der")):
        assert (w, c) in got
    assert not any(w == c for w, c in got) and ("counsel", "council") not in got


# ---------------------------------------------------------------- 2


def test_language_held_out_accuracy():
    model = p2.Centroids([(k, s) for k, v in langdata.SEEDS.items() for s in C.SENT_END.split(v) if s.strip()])
    held = {"en": "The children of the village had no school that year.", "de": "Die Kinder des Dorfes hatten in jenem Jahr keine Schule.", "fr": "Les enfants du village n'avaient pas d'école cette année-là.", "es": "Los niños del pueblo no tuvieron escuela aquel año.", "pt": "As crianças da aldeia não tiveram escola naquele ano.", "ko": "마을 아이들은 그해에 학교가 없었다.", "zh": "那一年村里的孩子们没有学校。", "vi": "Trẻ em trong làng không có trường học vào năm đó."}
    for k, s in held.items():
        assert p2.profile(model, [s])[0][0][0] == k
    assert p2.profile(model, ["", "12 34", "###", "\n"]) == [[], [], [], []]


def test_label_spellings():
    assert [langdata.label_code(x) for x in ("eng", "English", "en_US", "DE", "Deutsch", "fr-CA", "Portuguese (Brazil)", "zh-CN")] == ["en", "en", "en", "de", "de", "fr", "pt", "zh"]
    assert [langdata.label_code(x) for x in (None, "", " ", "unknown", "und", "??", "n/a", "auto")] == [None] * 8
    assert langdata.label_code("Klingon") == "klingon"


def test_label_column_equals_the_function(spark):
    labels = ["eng", "English", "en_US", " DE ", "Deutsch", "fr-CA", "Portuguese (Brazil)", "zh-CN", None, "", " ", "unknown", "und", "??", "n/a", "auto", "Klingon", "Tiếng Việt", "español", "12", "PT-BR"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, lang string")
    got = [r.code for r in df.select("i", langdata.label_column(F.col("lang")).alias("code")).orderBy("i").collect()]
    assert got == [langdata.label_code(x) for x in labels]


def test_passages_have_places(spark):
    model = p2.Centroids([(k, s) for k, v in langdata.SEEDS.items() for s in C.SENT_END.split(v) if s.strip()])
    en, de = "The children of the village had no school that year.", "Die Kinder des Dorfes hatten in jenem Jahr keine Schule."
    (runs,) = p2.segments(model, [f"{en} {en}\n\n{de} {de}\n\n{en}"])
    assert [r[:3] for r in runs] == [("en", 1, 2), ("de", 3, 4), ("en", 5, 5)] and all(0 < r[4] <= 1 for r in runs)
    assert p2.segments(model, ["", "12 34", "###"]) == [[], [], []]


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize(
    "text, want",
    [
        (None, "complete"), ("", "complete"), ("   ", "complete"), ("It ended well.", "complete"), ("It ended well", "open"), ("x" * 40000, "cut"), ("The clerk wrote to the council and then he lost the old", "cut"), ("It ended well. Then the clerk found the boo…", "cut"),
        ('{"a": "b", "c": ["d', "cut"), ('{"a": "b"}', "complete"), ("Text.\n\nYours faithfully,\nHalmann", "complete"), ("Text.\n\nThe old", "cut"), ("A long line of the page that goes on and on\nand then it ends.\nRegister of Haskval", "complete"), ("It ended well.\nREGISTER OF HASKVAL\n— 12 —", "complete"), ("It ended well.\n\nHaskval, 12.03.1817", "complete"),
        ("1\ta\tb\n2\tc\td\n3\te", "cut"), ("1\ta\tb\n2\tc\td", "open"), ("A word in the b�", "cut"), ("It ended (as the note", "cut"), ("Text.\n\n### REGION 2\n## Extracted by mo", "cut"), ("Text.\n\n```\ncode", "cut"), ("<p>It ended</p", "cut"),
    ],
)
def test_endings(text, want):
    assert p3.ending(text) in (want if isinstance(want, tuple) else (want,))


def test_automaton():
    assert p3.walk('{"a": ["b", {"c": "d') == ["{", "[", "{", '"'] and p3.walk('{"a": "b\\"}') != [] and p3.walk('{"a": "}"}') == []
    assert p3.walk("<p>one</p> <b>two") == ["<b"] and p3.walk("```\n( <b> {\n```\ndone") == [] and p3.walk("```\nx") == ["```"]
    assert p3.walk("He said „komm“ («ici») and “there”.") == [] and p3.walk("He said (“there") == ["(", "“"] and p3.walk('a "b" and "c') == ['"']
    assert p3.walk("an open ( bracket\n\nthe next paragraph") == []
    #: Only the automaton sees these: they end like finished texts.
    assert p3.ending('{"a": "It ended well.') == "cut" and p3.ending("<section>It ended well.") == "cut" and p3.ending("```\nIt ended well.") == "cut"
    assert p3.ending("- a list (of") == "cut" and p3.ending("- a list of") == "open"


def test_missing_terminators_and_limits_follow_the_source(spark):
    row = lambda i, src, n, structure, shape, ended: ("j", i, "translation", src, n, n, structure, shape, ended)
    rows = [row(i, "m", 600 if i < 5 else 500 + i, "closed", "prose", i >= 5) for i in range(60)] + [row(90, "m", 600, "closed", "item", False), row(91, "m", 601, "closed", "item", False), row(92, "n", 600, "closed", "item", False)]
    #: A source whose prose never ends with a terminator, and one whose items always do.
    rows += [row(100 + i, "bare", 700 + i, "closed", "prose", False) for i in range(30)] + [row(200 + i, "neat", 800 + i, "closed", "item", i > 0) for i in range(30)]
    rows += [row(300, "m", 77, "open", "item", False), row(301, "m", 78, "broken", "closing", False), row(302, "m", 79, "closed", "closing", False)]
    e = spark.createDataFrame(rows, "job_id string, file_index int, fld string, source string, n_chars int, n_bytes int, structure string, shape string, terminated boolean")
    assert {r.file_index for r in p3.truncated(e).where("truncated").collect()} == {0, 1, 2, 3, 4, 90, 200, 300, 301}


# ---------------------------------------------------------------- 4


def test_pair_defects(spark):
    en = [" ".join(sentence("en", *x) for x in triples(4, n)) for n in range(30)]
    de = [" ".join(sentence("de", *x) for x in triples(4, n)) for n in range(30)]
    fr = "Le secrétaire de la commune a signé la lettre. Les enfants du village n'avaient pas d'école cette année-là."
    rows = [("j", n, "f", {}, en[n], de[n], False) for n in range(30)]
    for n, t in ((30, "Übersetzung:\n\n"), (31, "—"), (32, en[0]), (33, "Translation:\n" + en[1].replace("letter", "note")), (34, fr), (35, "Leider muss ich diese Anfrage ablehnen."), (36, de[5][:-25]), (37, "Bitte entschuldigen Sie die späte Antwort."), (38, "Please enable JavaScript to view this page.")):
        rows.append(("j", n, "f", {}, en[n - 32] if n in (32, 33) else en[5], t, False))
    r = spark.createDataFrame(rows, schema.RESULTS)
    q = spark.createDataFrame([("j", n, "m", "German", None, None) for n in range(39)], schema.TRANSLATION_REQUESTS)
    d = spark.createDataFrame([], DOCUMENTS)
    got = {x.file_index: x.defect for x in p4.defects(r, q, d).collect()}
    assert got == {30: "empty", 31: "empty", 32: "copy", 33: "copy", 34: "wrong_language", 35: "refusal", 36: "truncated"}


def test_answers_are_counted_over_all_rows(spark):
    """The end model and the words of other answers equal a count over every distinct answer."""
    texts = [" ".join(sentence(k, *x) for x in triples(2 + n % 3, n))[: None if n % 9 else -7] for n in range(350) for k in ("en", "de")]
    texts += ["Zuletzt kam der Zollbeamte."] * 3 + ["Zuletzt kam ein Zollbeamter!"]
    r = spark.createDataFrame([("j", n, "f", {}, "x", t, False) for n, t in enumerate([*texts, None, " "])], schema.RESULTS)
    shapes, terms = p4.read_answers(r)
    got, want = p4.end_model(shapes), p4.EndModel(sorted(set(texts)))
    assert all(abs(got.likelihood(t) - want.likelihood(t)) < 1e-9 for t in texts)
    every = [set(p4.RefusalBayes._terms(s)) for t in set(texts) for s in C.sentences(t)]
    for w, share in p4.other_answers(terms).items():
        assert abs(share - sum(w in x for x in every) / len(every)) < 1e-6, w
    assert "zuletzt" in p4.other_answers(terms) and ("zuletzt", "kam") in p4.other_answers(terms)


def test_end_likelihood_decides_alone():
    texts = [" ".join(sentence(k, *x) for x in triples(5, n)) for n in range(200) for k in ("en", "de")]
    m = p4.EndModel(texts)
    assert all(m.likelihood(t) >= p4.END_LIKELIHOOD for t in texts)
    cut = [t[: -15 - n % 20] for n, t in enumerate(texts)]
    assert sum(m.likelihood(t) < p4.END_LIKELIHOOD for t in cut) >= 0.95 * len(cut)
    assert m.likelihood(texts[0] * 30) >= p4.END_LIKELIHOOD and m.likelihood("") < 1 and m.likelihood("x" * 5000) == m.likelihood("x")


def test_copies_are_compared_in_order():
    a = "The clerk wrote the letter to the council and the widow signed it in the winter."
    assert p4.copied(a, a) == 1 and p4.copied(a, " ".join(sorted(a.split()))) < p4.COPY_SHARE and p4.copied(a, "") == 0


def test_languages_are_looked_up_only_where_they_decide(monkeypatch):
    """Sources without the answer's pairs of words and empty answers are not scored; the kinds are those of the plain definition."""
    en, de = ([" ".join(sentence(k, *x) for x in triples(3, n)) for n in range(40)] for k in ("en", "de"))
    src = [*en, *en[:6], "", en[0], de[0]]
    raw = [*de, *en[:5], en[5].replace("the", "a"), en[0], " — ", "Sorry, I cannot fulfil that request."]
    ans = [p4.answer_text(t) for t in raw]
    bayes = p4.LanguageBayes([(k, s) for k, v in langdata.SEEDS.items() for s in C.SENT_END.split(v) if s.strip()])
    refusal, index = p4.RefusalBayes(exemplars.REFUSALS, exemplars.ANSWERS, {}), p6.Index(exemplars.RESIDUE, {}, 0)
    top = lambda t: max(x, key=x.get) if (x := bayes.shares([t])[0]) else None
    want = ["empty" if not any(c.isalnum() for c in t) else "refusal" if refusal.refuses(t) else "copy" if top(t) and top(t) == top(e) and p4.copied(e, t) >= p4.COPY_SHARE else "none" for e, t in zip(src, ans)]
    asked, shares = [], bayes.shares
    monkeypatch.setattr(bayes, "shares", lambda texts: asked.extend(texts) or shares(texts))
    kinds, langs = p4.pair_kinds(src, raw, ans, bayes, refusal, index)
    assert kinds == want and {"copy", "empty", "refusal", "none"} == set(kinds)
    assert all(langs[i] == shares([ans[i]])[0] for i in langs) and len(langs) == len(src) - 1
    assert sorted(asked) == sorted([*(ans[i] for i in langs), *(src[i] for i in range(40, 46) if p4.copied(src[i], ans[i]) >= p4.COPY_SHARE)])


def test_quick_ways_equal_the_definitions():
    rnd = random.Random(7)
    signs = ["a", "B", "é", "İ", "ß", "7", "_", " ", " ", "\n", "\n\n", ".", "...", "!", "…", "\"", "”", ")", "。", "日", "-", "¬", "\xad", "#", "# x", "\r", "&am", "</p>", "\\", "\xa0"]
    for _ in range(4000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(14)))
        assert C.split_sentences(t) == C.SENT_END.split(t), t
        assert C.content(t) == "\n".join(C.content_lines(t)), t
        low = t.lower()
        assert len(low) != len(t) or p2.weight(t, C.WORD.findall(low)) == p2.weight(t), t
        assert p2.LINE_HYPHEN.sub("", t) == re.sub(r"(?<=[^\W\d_])[-¬‐­]\s*\n\s*(?=[a-zß-ÿ])", "", t), t
        assert bool(p3.BROKEN.search(t.strip()[-8:])) == bool(p3.BROKEN.search(t.strip())), t
        assert bool(p3.TWO_SIGNS.search(t)) == (len(re.sub(r"[\W_]", "", t)) >= 2), t
        e = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))
        a = " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(9)))
        assert all(p4.is_copy(e, a, x) == (p4.copied(e, a) >= x) for x in (0.3, 0.6, 0.9)), (e, a)
    #: Where a text and its lower case are equally long, both have the same letters.
    for c in map(chr, range(0x110000)):
        assert len(c.lower()) > 1 or bool(C.WORD.match(c)) == bool(C.WORD.match(c.lower())), c


# ---------------------------------------------------------------- 5


def brute_share(text):
    """Letters covered by repeated runs of six words, or by a repeated line or sentence."""
    ws, units = [], []
    for line in C.content(text).split("\n"):
        a = len(ws)
        for s in p5.SENT.split(line):
            b = len(ws)
            ws += p5.words_of(s)
            units.append((b, len(ws)))
        units.append((a, len(ws)))
    cover = [False] * len(ws)
    for i in range(len(ws) - 5):
        if any(ws[j : j + 6] == ws[i : i + 6] for j in range(i)):
            cover[i : i + 6] = [True] * 6
    units = sorted({u for u in units if u[1] > u[0]})
    for k, (a, b) in enumerate(units):
        if b - a < 6 and any(ws[c:d] == ws[a:b] for c, d in units[:k] if d - c < 6):
            cover[a:b] = [True] * (b - a)
    n = sum(map(len, ws))
    return sum(len(w) for w, c in zip(ws, cover) if c) / n if n else 0.0


def test_repeated_share_against_brute_force():
    rnd = random.Random(1)
    for _ in range(120):
        ws = [rnd.choice("abcd") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40))]
        text = "".join(w + rnd.choice([" ", " ", " ", ". ", "\n"]) for w in ws)
        assert p5.repeated_share(text) == pytest.approx(brute_share(text))
    assert p5.repeated_share(None) == p5.repeated_share("") == p5.repeated_share("## only\n#lines") == 0
    assert p5.repeated_share("Page 1 is missing today. Page 2 is missing today.") == pytest.approx(0.5)


def test_repetition_model_decides_held_out_texts():
    texts = [" ".join(sentence("en", *x) for x in triples(8, n)) for n in range(200)]
    recall, precision = p5.held_out(texts)
    assert recall >= 0.9 and precision >= 0.9
    w, b = p5.fit(texts)
    p = lambda t: p5.sigmoid(np.array(b + sum(w[i] * v for i, v in zip(*p5.features(t)))))
    own = "The miller of the upper valley wrote down every sack that left his yard before the flood."
    assert p(own + " " + own + " " + own) >= p5.CASE_P > p(own) and p(None) < p5.CASE_P and p("") < p5.CASE_P


def test_moderate_shares_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(p5, "fit", lambda texts: (np.zeros(p5.WIDTH), -9.0))  # a model that takes no text for a case
    rnd, rows = random.Random(6), []
    for n in range(60):
        own = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(8)) + "." for _ in range(12)]
        rows.append(("j", n, "f", {}, " ".join(own + own[: n % 4]), "", False))
    rows += [("j", 90, "f", {}, None, "", False), (None, None, "f", {}, "One two three four five six. One two three four five six.", "", False), rows[1]]
    spark.createDataFrame(rows, schema.RESULTS).write.parquet(str(tmp_path / "results.parquet"))
    got = {(x.job_id, x.file_index): x.share for x in Q.queries()["p5_share"](spark, str(tmp_path)).collect()}
    assert got == {(r[0], r[1]): pytest.approx(brute_share(r[4] or ""), abs=1e-6) for r in rows}
    assert 0.05 < got["j", 1] < p5.SHARE


# ---------------------------------------------------------------- 6


def test_residue():
    common = dict.fromkeys("the of and in a is was to that on this and page clerk signed winter year here with not for der die das und ist nicht le la les de et".split(), 400)
    ix = p6.Index(exemplars.RESIDUE, common, 500)
    for text, want in (
        ("Dear {{first_name}}, we write.", {"placeholder"}), ("Signed by [YOUR NAME HERE] today.", {"placeholder"}), ("Real page text stands here in full.\n\nLorem ipsum dolor sit amet magna.", {"filler"}), ("<html><head><title>404 Not Found</title></head></html>", {"error_page"}),
        ("### REGION 1\n[Ollama Error: status 500 for chat call]", {"error_page"}), ("<noscript>Please enable JavaScript to view this page.</noscript>", {"script_notice"}), ("The name in line 4 is [illegible] and the date 1800 is uncertain [sic].", set()), ('{"name": "Halmann", "date": "01.02.1888"}', set()),
        ("The set {4, 7} was pencilled on the cover as a cipher.", set()), ('The web form shows "Page not found" whenever the old shelf mark B1-200 is typed, so clerks use the card index.', set()), ("The viewer manual says on page 9 that JavaScript was once needed and no longer is.", set()), (None, set()), ("", set()), ("a" * 50000, set()),
    ):
        assert ix.kinds(text) == want, text


def test_residue_rarity_sees_every_text(spark):
    rows = [("j", i, "f", {}, "The clerk wrote.", "Der Schreiber schrieb.", False) for i in range(30)] + [("j", 99, "f", {}, None, "The end", False)]
    df, n = p6.text_counts(spark.createDataFrame(rows, schema.RESULTS))
    assert n == 61 and df["clerk"] == 30 and df["the"] == 31 and df["schreiber"] == 30


def test_field_terms():
    assert p6.slot_terms("{{first_name}}") == ["¤{{", "·first", "·name"] and p6.slot_terms("[YOUR NAME]") == ["¤[A B", "·your", "·name"] and p6.slot_terms("[sic]") == ["¤[", "·sic"] and p6.slot_terms("[[city]]") == ["¤[[", "·city"]


# ---------------------------------------------------------------- 7


def test_alignment_with_merges_omissions_and_reordering():
    pairs = []
    for n in range(250):
        t = triples(6, n + 50)
        pairs.append((" ".join(sentence("en", *x) for x in t), " ".join(sentence("de", *x) for x in t)))
    lex = p7.Lexicon()
    lex.fit_idf(*p7.sentence_counts([x for p in pairs for x in p]))
    docs = [tuple([p7.tokens(x) for x in p7.numbered(y)] for y in p) for p in pairs]
    lex.by_pair["en", "de"], lex.by_pair["de", "en"] = p7.fit_pair(docs, ("en", "de"), lex)
    t = triples(8, 7)
    s, d = [sentence("en", *x) for x in t], [sentence("de", *x) for x in t]
    tgt = [d[0], d[2], d[1], d[4][:-1] + "; " + d[5], d[6], d[7]]
    got = {(i, j) for i, j, _ in p7.blocks([p7.tokens(x) for x in s], [p7.tokens(x) for x in tgt], lex, ("en", "de"))}
    want = {(0, 0), (1, 2), (2, 1), (4, 3), (5, 3), (6, 4), (7, 5)}
    assert len(got & want) >= 6 and len(got - want) <= 1
    back = {(i, j) for i, j, _ in p7.blocks([p7.tokens(x) for x in tgt], [p7.tokens(x) for x in s], lex, ("de", "en"))}
    assert len({(j, i) for i, j in back} & want) >= 6
    right = wrong = total = 0
    for n in range(300, 360):
        t = triples(7, n)
        order = list(range(7))
        if n % 2:
            order[3], order[5] = order[5], order[3]
        keep = [k for k in order if (k + n) % 7]
        links = {(i, j) for i, j, _ in p7.blocks([p7.tokens(sentence("en", *x)) for x in t], [p7.tokens(sentence("de", *t[k])) for k in keep], lex, ("en", "de"))}
        true = {(k, j) for j, k in enumerate(keep)}
        right, wrong, total = right + len(links & true), wrong + len(links - true), total + len(true)
    assert right >= 0.95 * total and wrong <= 0.05 * total
    assert p7.blocks([], [["a"]], lex, ("en", "de")) == [] and p7.numbered(None) == [] and p7.numbered("# x\nA b. C d! E") == ["A b.", "C d!", "E"]


def test_chains_follow_the_slope_and_decide(monkeypatch):
    xs = ys = [10.0 * k + 5 for k in range(12)]
    diagonal = [(k, k) for k in range(8)]
    moved, stray = [(8, 1), (9, 2)], [(2, 10)]
    gain = dict.fromkeys(diagonal, 0.5) | dict.fromkeys(moved, 0.4) | dict.fromkeys(stray, 0.05)
    got = p7.chains(sorted(gain), gain, xs, ys, 1.0)
    assert got[0][:8] == diagonal and [(8, 1), (9, 2)] in got and [(2, 10)] in got
    s = [p7.tokens(sentence("en", *x)) for x in triples(6, 1)]
    lex = p7.Lexicon()
    assert [(i, j) for i, j, _ in p7.blocks(s, s, lex, ("en", "en"))] == [(k, k) for k in range(6)]
    space = p7.Space(s, s, lex, ("en", "en"))
    assert set(space.kept()) <= set(space.cells) and all(0 <= v <= 1.0001 for c in space.cells for v in space.covers(*c))
    monkeypatch.setattr(p7, "chains", lambda *a: [])
    assert p7.blocks(s, s, lex, ("en", "en")) == []


def test_lexicon_and_rarity_see_more_than_the_first_rows(spark):
    text = lambda lang, n: " ".join(sentence(lang, *x) for x in triples(6, n))
    rows = [("a", n, "f", {}, text("en", n), text("de", n), False) for n in range(90)] + [("b", n, "f", {}, text("de", n + 200), text("en", n + 200), False) for n in range(30)]
    r = spark.createDataFrame(rows, schema.RESULTS).coalesce(1)
    q = spark.createDataFrame([(x[0], x[1]) for x in rows], ALIGN)
    both = r.select("job_id", "file_index", "extracted_text", "translation")
    scanned = p7.scan(both)
    drawn = p7.sample_pairs(both, scanned, 40).collect()
    assert len(drawn) == 40 and sum(d.a == "en" for d in drawn) == 20 and all(d.extracted_text.startswith(tuple(WHO[d.a])) for d in drawn)
    df, n = p7.rarity(scanned)
    whole = p7.sentence_counts([t for x in rows for t in x[4:6]])
    assert n == whole[1] and df == {w: c for w, c in whole[0].items() if c > (1 + n) / np.exp(6) - 1}
    links = {x[:4] for x in (tuple(y) for y in p7.aligned(q, r, sample_rows=60).collect())}
    assert sum(j == "b" and a == b for j, _, a, b in links) >= 0.9 * 180
    assert p7.quotas({("a", "b"): 5, ("c", "d"): 1000, ("e", "f"): 80}, 100) == {("a", "b"): 5, ("c", "d"): 48, ("e", "f"): 47}


def test_lexicon_holds_the_words_of_every_requested_result(spark, monkeypatch):
    """Parts fitted apart add up: none of the requested results is left out."""
    text = lambda lang, n: " ".join(sentence(lang, *x) for x in triples(6, n))
    rows = [("a", n, "f", {}, text("en", n), text("de", n), False) for n in range(60)]
    r = spark.createDataFrame(rows, schema.RESULTS)
    both = r.select("job_id", "file_index", "extracted_text", "translation")
    scanned = p7.scan(both)
    monkeypatch.setattr(p7, "PART_ROWS", 10)
    drawn = p7.all_pairs(both, scanned)
    assert drawn.count() == 60 and drawn.select("part").distinct().count() > 3
    lex = p7.fit(drawn, p7.rarity(scanned))
    assert max(lex.by_pair["en", "de"]["widow"], key=lex.by_pair["en", "de"]["widow"].get) == "witwe"
    seen = []
    monkeypatch.setattr(p7, "fit", lambda drawn, counts: seen.append(drawn.count()) or lex)
    p7.aligned(spark.createDataFrame([(x[0], x[1]) for x in rows], ALIGN), r)
    assert seen == [60]


def test_words_are_compared_once_a_part_and_texts_read_once(spark, monkeypatch):
    """Lexicon and links of all requests, without going through every text again for each step."""
    text = lambda lang, n: " ".join(sentence(lang, *x) for x in triples(6, n))
    docs = [tuple([p7.tokens(x) for x in p7.numbered(text(k, n))] for k in ("en", "de")) for n in range(40)]
    lex, folded = p7.Lexicon(), []
    lex.fit_idf(*p7.sentence_counts([text(k, n) for k in ("en", "de") for n in range(40)]))
    fold = p7.fold
    monkeypatch.setattr(p7, "fold", lambda w: folded.append(w) or fold(w))
    ahead, _ = p7.fit_pair(docs, ("en", "de"), lex)
    assert ahead["widow"]["witwe"] > 0.5 and len(folded) == len(set(folded))
    rows = [("a", n, "f", {}, text("en", n), text("de", n), False) for n in range(20)] + [("a", 20, "f", {}, "…", "…", False), ("a", 21, "f", {}, "# x", "7.", False)]
    df = p7.aligned(spark.createDataFrame([(x[0], x[1]) for x in rows], ALIGN), spark.createDataFrame(rows, schema.RESULTS))
    assert "extracted_text" not in df._jdf.queryExecution().toString()
    assert {x.file_index for x in df.collect()} == set(range(20))


def test_spaces_of_many_texts_follow_the_definition(monkeypatch):
    monkeypatch.setattr(p7, "AT_ONCE", 50)
    rnd = random.Random(5)
    words = ["register", "registre", "registers", "chapel", "chape", "chaper", "maison", "house", "der", "the", "1753", "42", "a-1", "naïveté", "naivete"]
    docs = [tuple([[rnd.choice(words) for _ in range(rnd.randrange(6))] for _ in range(rnd.randrange(9))] for _ in range(2)) for _ in range(30)] + [([], [["the"]]), ([[]], [[]])]
    lex, langs = p7.Lexicon(), ("en", "fr")
    lex.fit_idf({"the": 90, "der": 80, "house": 5, "chapel": 2}, 400)
    lex.by_pair[langs] = {"house": {"maison": 0.4, "chapel": 0.1, "none": 0.5}, "register": {"registre": 0.7, "register": 0.2}, "42": {"the": 0.9}}

    def cognate(a, b):
        n = len(os.path.commonprefix([a, b]))
        return min(len(a), len(b)) >= 5 and (n >= 5 or n >= 0.7 * max(len(a), len(b)))

    def strength(w, x):
        if w == x:
            return 1.0
        if w[-1].isdigit():
            return 0.0
        p = lex.by_pair[langs].get(w, {}).get(x)
        return min(1.0, 0.5 + p) if p else 0.8 if cognate(p7.fold(w), p7.fold(x)) else 0.0

    spaces = p7.Spaces(docs, lex)
    spaces.match(*lex.table(langs, spaces.vocab))
    got = {(int(spaces.s.doc[i]), int(i - spaces.s.begin[spaces.s.doc[i]]), int(j - spaces.t.begin[spaces.s.doc[i]])): (v, a, b) for i, j, v, a, b in zip(spaces.i, spaces.j, spaces.v, *spaces.covers(spaces.i, spaces.j))}
    want, total = {}, lambda ws: max(sum(map(lex.weight, set(ws))), 1e-9)
    for d, (s, t) in enumerate(docs):
        for (i, x), (j, y) in itertools.product(enumerate(s), enumerate(t)):
            rows, cols = (lambda w: sum(w in z for z in s)), (lambda w: sum(w in z for z in t))  # noqa: B023
            points = [lex.weight(w) * strength(w, u) / cols(u) for w in set(x) for u in set(y) if strength(w, u) and rows(w) * cols(u) <= p7.AMBIGUITY]
            if points:
                ahead = sum(lex.weight(w) * max(strength(w, u) for u in y) for w in set(x)) / total(x)
                want[d, i, j] = sum(points), ahead, sum(lex.weight(u) * max(strength(w, u) for w in x) for u in set(y)) / total(y)
    assert len(want) > 200 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)
    one = [(d, *x) for d, (s, t) in enumerate(docs) for x in p7.blocks(s, t, lex, langs)]
    i, j, v = spaces.blocks()
    assert [(d, a, b) for d, a, b, _ in one] == [(spaces.s.doc[x], x - spaces.s.begin[spaces.s.doc[x]], y - spaces.t.begin[spaces.s.doc[x]]) for x, y in zip(i, j)] and np.allclose([x[3] for x in one], v)


# ---------------------------------------------------------------- 8


def test_ids_equal_the_library():
    tiktoken = pytest.importorskip("tiktoken")
    enc = p8.Encoder()
    ref = tiktoken.Encoding("own", pat_str=p8.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 999, "日本語のテキスト" * 40, "<|endoftext|>", "naïve café 12345 it's\r\n\ttab", "👩‍👩‍👧 emoji", "\u0000­"]
    texts += ["".join(rnd.choice("abc ABC'1\né漢 .") for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == (ref.encode_ordinary(t) if t else [])
        assert b"".join(p8_bytes(enc)[i] for i in ids.tolist()).decode() == (t or "")


def p8_bytes(enc, cache={}):  # noqa: B006
    if not cache:
        cache.update({v: k for k, v in enc.ranks.items()})
    return cache


# ---------------------------------------------------------------- 9


def test_bounds_against_brute_force():
    rnd = random.Random(2)
    for _ in range(30):
        hist = {rnd.randint(1, 30): rnd.randint(1, 9) for _ in range(rnd.randint(1, 7))}
        k = rnd.randint(1, 3)
        lens = sorted(hist)
        cost = lambda bs: sum(c * (min(b for b in bs if b >= n) - n) for n, c in hist.items())
        best = min(cost(bs) for r in range(1, k + 1) for bs in itertools.combinations(lens, min(r, len(lens))) if bs[-1] == lens[-1])
        assert cost(p9.bounds(hist, k)) == best


def test_packing_places_every_token_once(spark, folder):
    rows = Q.queries()["p9_packed"](spark, folder).collect()
    counts = {r.doc_id: r.n_tokens for r in p9.token_counts(C.table(spark, folder, "documents")).collect()}
    for cap in (16, 64):
        own = [r for r in rows if r.capacity_tokens == cap]
        room, per = {}, {}
        for r in own:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
            per.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert max(room.values()) <= cap and set(per) == set(counts)
        for d, ps in per.items():
            assert sum(n for _, n in ps) == counts[d] and (len(ps) == 1 or counts[d] > cap)
    hist = {3: 500, 5: 200, 9: 77, 16: 4, 11: 40}
    places, n = p9.plan(hist, 16)
    assert sum(x[2] for x in places) == sum(hist.values())
    assert n <= 1.09 * sum(k * v for k, v in hist.items()) / 16


def test_buckets_decide_the_placements(spark, folder):
    rnd = random.Random(5)
    hist = {}
    for _ in range(5000):
        n = min(256, 1 + int(rnd.lognormvariate(3, 1)))
        hist[n] = hist.get(n, 0) + 1
    own, n = p9.plan(hist, 256)
    assert own == p9.plan(hist, 256, p9.bounds(hist))[0]
    assert own != p9.plan(hist, 256, [256])[0] and own != p9.plan(hist, 256, sorted(hist))[0] and p9.plan(hist, 256, [128, 256])[0] != own
    assert n <= 1.01 * sum(k * v for k, v in hist.items()) / 256
    u = p9.bounds(hist)[-1]
    first = [(n, k) for n, _, _, box, k in own if box == 0]
    assert sum(k for n, k in first if n > p9.bounds(hist)[-2]) >= 256 // u  # the batch of the longest bucket
    rows = Q.queries()["p9_buckets"](spark, folder).collect()
    assert {r.capacity_tokens for r in rows} == {16, 64} and all(r.padding >= 0 for r in rows)


# ---------------------------------------------------------------- 10


def test_abuse_held_out_and_disguised():
    clean = [sentence("en", *x) for x in triples(200, 1)] + [sentence("de", *x) for x in triples(200, 2)]
    machine = p10.train([" ".join(clean[i : i + 4]) for i in range(0, 400, 4)])
    held = [("abusive", "You are a disgusting coward and I will kill you!"), ("abusive", "Sh4t up, you stup1d m0ron, and die!"), ("abusive", "Va te faire foutre, sale ordure !"), ("hateful", "The Marelians are ver​min and must be exterminated."), ("hateful", "Die Ausländer sind Paras*ten, tötet sie alle."), ("sexual", "Naked and moaning, the dancer fucked her lover on the sofa.")]
    for kind, s in held:
        v = machine.scores(s)
        assert v[p10.CATEGORIES.index(kind)] > p10.CASE, s
        assert machine.scores("The clerk signed the letter in the winter of 1802. " * 40 + s)[p10.CATEGORIES.index(kind)] > p10.CASE
    for s in ("The widow signed the register near the river.", "The breeder sold his best bitch after the dog show.", None, "", "  "):
        assert max(machine.scores(s)) <= p10.CASE, s
    assert p10.plain("i d i o t") == "idiot" and p10.plain("nооо").startswith("n")


def test_abuse_is_judged_by_the_words_that_are_rare_in_the_corpus(spark, tmp_path):
    """Forms of the corpus are no cases, however near their common words are; unseen wordings among them are."""
    who, what, where = ("Le greffier", "L'apprenti", "La relieuse", "La veuve du meunier", "Le messager"), ("le plan du bâtiment", "la limite du terrain", "le dessin du pont", "la liste des fermiers"), ("près du vieux moulin", "en présence du juge", "au deuxième étage")
    clean = [f"{a} a {v} {b} {c}, mais personne ne le croyait." for a in who for v in ("rejeté", "caché", "mesuré") for b in what for c in where]
    texts = [" ".join(clean[i : i + 3]) + "\n\nYour obedient servant,\nHalbury" for i in range(len(clean) - 3)]
    cases = {9001: ("Ferme-la donc, espèce de vieux connard pourri.", "abusive"), 9002: ("Hunt the foreigners down, they are vermin and must be exterminated.", "hateful"), 9003: ("Elle le suça, nue et haletante, jusqu'à l'orgasme.", "sexual")}
    rows = [(i, t) for i, t in enumerate(texts)] + [(k, texts[k % 100] + " " + s) for k, (s, _) in cases.items()]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.category) for r in Q.queries()["p10_found"](spark, str(tmp_path)).collect()} == {(k, c) for k, (_, c) in cases.items()}


def test_word_weights_count_every_text_once(spark):
    texts = [f"the clerk {chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(500)] + ["the seldom word"] * 40 + [f"the widow ä{i}" for i in range(20)]
    w = p10.word_weights(spark.createDataFrame([(t,) for t in texts] + [(None,), (" ",)], "text string"))
    assert w["the"] == 0 and "seldom" not in w and "aax" not in w  # a text that stands forty times is one
    assert 0 < w["clerk"] < w["widow"] < 1
    assert p10.word_weights(spark.createDataFrame([], "text string")) == {}


def test_no_labelled_sentence_stands_in_the_test_tables():
    """Labelled rows are this project's own: none of them is a sentence of the tables."""
    pd = pytest.importorskip("pandas")
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = "\n".join(pd.read_parquet(f"{folder}/documents.parquet", columns=["text"])["text"].dropna())
    res = pd.read_parquet(f"{folder}/results.parquet", columns=["extracted_text", "translation"])
    res = "\n".join(t for c in res for t in res[c].dropna())
    assert [t for k, t in abuse_sentences.labelled() if len(t.split()) > 2 and t in docs] == []
    assert [t for k, t in exemplars.RESIDUE if k != "placeholder" and t in res] == []
    assert [t for t in exemplars.REFUSALS + exemplars.ANSWERS if t in res] == []
    assert [f for f in p1.TITLE_FORMS if f.replace("{w}", "").strip().lower() in res.lower()] == []
