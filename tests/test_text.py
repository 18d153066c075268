"""Text kernels against plain Python, over hand-made texts and all paragraphs of the smallest data."""

import re

import pytest
from pyspark.sql import functions as F

from kodex.functions import legal, text
from kodex.functions.regex import find_all
from kodex.operators import extract
from kodex.patterns import PATTERNS
from kodex.plans import text as plans

TEXTS = [
    "Viz č. j. 6 Ads 45/2014-32 a sp. zn. II. ÚS 2379/08, též sp. zn. Pl. ÚS 29/98.",
    "ECLI:CZ:NSS:2015:6.Ads.45.2014.32 a R 12/2015; § 2000 odst. 1 zákona č. 89/2012 Sb. a § 5.",
    "", "   ", "bez citace", "§§ 1 § 2", "😀 § 3 odst. 4 😀 č. j. 1 As 2/2010 - 7", "sp. zn. 4 As 1/2011" * 3, "R 1/2000R 2/2000 R 3/2000",
    "§ 10a odst. 2 písm. b) zák. č. 99/1963 Sb.\n§ 11", None,
]
ABBREVIATIONS = set(text.ABBREVIATIONS.split())


def plain_sentences(body):
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+", body, re.ASCII):
        last = re.search(r"(\S+)\Z", body[: m.start()])
        if last and (last[1].lower() in ABBREVIATIONS or re.fullmatch(r"[0-9IVXivx]+\.", last[1])):
            continue
        out.append((start, body[start : m.start()]))
        start = m.end()
    out.append((start, body[start:]))
    return [(a, s.rstrip()) for a, s in out if s.strip()]


def plain_spans(body):
    found = []
    for i, p in enumerate(PATTERNS):
        for m in re.finditer(p.regex, body, re.ASCII):
            found.append((m.start(), m.end(), i, p.kind, m[0], {g: v for g, v in zip(p.groups, m.groups()) if v}))
    inside = lambda o, s: o[0] <= s[0] and o[1] >= s[1] and ((o[0], o[1]) != (s[0], s[1]) or o[2] < s[2])
    return sorted([s for s in found if not any(inside(o, s) for o in found)], key=lambda s: s[:3])


@pytest.fixture(scope="module")
def bodies(spark, data):
    stored = [r[0] for r in spark.read.parquet(f"{data}/decision_paragraph.parquet").select("body").collect()]
    return spark.createDataFrame([(i, b) for i, b in enumerate([*TEXTS, *stored])], "i int, body string").cache()


def test_find_all(bodies):
    for p in PATTERNS:
        for r in bodies.select("body", find_all(F.col("body"), p.regex, p.groups).alias("m")).collect():
            if r.body is None:
                assert r.m is None
                continue
            want = [(m[0], m.start(), m.end(), {g: v for g, v in zip(p.groups, m.groups()) if v}) for m in re.finditer(p.regex, r.body, re.ASCII)]
            assert [tuple(x) for x in r.m] == want, (p.name, r.body)


def test_spans_drop_contained(bodies):
    for r in bodies.filter("body is not null").select("body", extract.spans(F.col("body")).alias("s")).collect():
        assert [(x.start, x.end, x.pattern_ord, x.kind, x.raw, x.groups) for x in r.s] == plain_spans(r.body)


def test_sentences(bodies):
    for r in bodies.select("body", text.sentences(F.col("body")).alias("s")).collect():
        if r.body is None:
            assert r.s is None
        else:
            assert [tuple(x) for x in r.s] == plain_sentences(r.body), r.body


def one(spark, expression, *values):
    """expression of string columns a, b, ... for one row of values."""
    names = "abcdef"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    out = df.select(expression(*map(F.col, names)).alias("x")).first().x
    return out.asDict() if hasattr(out, "asDict") else out


def test_forms(spark):
    assert one(spark, text.squeeze, " a\xa0 b\x85\n c ") == "a b c"
    assert one(spark, text.alias_form, " ECLI:CZ \xa0Straße") == "ecli:cz straße"
    assert one(spark, text.unaccented, "Rozšířený\xa0Senát é") == "rozsireny senat e"
    assert one(spark, text.despaced, "O d ů v o d n ě n í") == "oduvodneni"
    assert one(spark, text.paragraphs, "a\n\nb c\n d\n \n\ne") == ["a", "b c d", "e"]
    assert one(spark, text.paragraphs, "a\nb\n") == ["a", "b"]
    assert one(spark, text.paragraphs, "") == []
    assert one(spark, text.paragraphs, None) is None
    assert one(spark, text.is_verbatim, "a\xa0b", "x a  b y") and not one(spark, text.is_verbatim, " ", "x") and not one(spark, text.is_verbatim, "A", "a")
    assert one(spark, text.is_verbatim, None, "a") is False
    assert one(spark, text.truncated, "x" * 121) == "x" * 120 + "..."
    assert one(spark, text.json_object, 'so: {"a": {"b": 1}} ok') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object, "none") is None
    assert one(spark, lambda a: text.render("x {{a}} y", a=a), "1") == "x 1 y"
    for bad in (lambda a: text.render("{{a}} {{b}}", a=a), lambda a: text.render("{{a}}", a=F.nullif(a, a))):
        with pytest.raises(Exception, match="left over|no value"):
            one(spark, bad, "1")


def test_legal_forms(spark):
    assert str(one(spark, legal.czech_date, "V Brně dne 9. července 2009")) == "2009-07-09"
    assert str(one(spark, legal.czech_date, "dne 4. 1. 2024 a 5. 2. 2023")) == "2024-01-04"
    assert one(spark, legal.czech_date, "31. 2. 2020") is None and one(spark, legal.czech_date, "nic") is None and one(spark, legal.czech_date, None) is None
    assert one(spark, legal.split_ref_no, "6 Afs 234/2023 -  50") == {"case_no": "6 Afs 234/2023", "ref_no": "6 Afs 234/2023-50"}
    assert one(spark, legal.split_ref_no, "6 Afs 234/2023") == {"case_no": "6 Afs 234/2023", "ref_no": "6 Afs 234/2023"}
    assert one(spark, legal.sign_parts, "iv.ÚS 3523/2020") == {"designator": "IV", "sequence": "3523", "year": "20"}
    assert one(spark, legal.sign_key, "Pl. ÚS 44/21") == "Pl-44-21_1" and one(spark, legal.sign_key, "IV. ÚS 3523/20") == "4-3523-20_1"
    assert one(spark, legal.sign_key, "VII. ÚS 1/20") is None and one(spark, legal.sign_key, "6 As 1/2020") is None
    assert one(spark, legal.sign_spellings, "II.ÚS 1/08") == ["II. ÚS 1/08", "II.ÚS 1/08"]
    assert one(spark, legal.same_sign, "Pl. ÚS 44/2021", "Pl.ÚS 44/21") and not one(spark, legal.same_sign, "x", "x")
    assert one(spark, legal.section_form, "§ 2000.") == "2000" and one(spark, legal.subsection_form, "odst. (1)") == "1" and one(spark, legal.subsection_form, " ") is None
    assert one(spark, legal.fragment_keys, "eli/par_10a/odst_2/frag_1") == {"section": "10a", "subsec": "2"}
    assert one(spark, legal.fragment_keys, "eli/cast_1") == {"section": None, "subsec": None}


@pytest.mark.parametrize("court,said,case_no,want", [
    ("NSS", "Nejvyšší správní soud rozhodl v rozšířeném senátu", "6 As 1/2020", "panel"),
    ("NSS", "rozšířený senát rozhodl", "6 As 1/2020", "extended"),
    ("NSS", "senát věc postoupil rozšířenému senátu", "6 As 1/2020", "panel"),
    ("NS", "ve velkém senátu; velký senát rozhodl", None, "grand"),
    ("US", "", "Pl. ÚS 1/20", "plenary"), ("US", "senát", "I. ÚS 1/20", "panel"), ("US", None, None, "unknown"),
])
def test_panel_type(spark, court, said, case_no, want):
    got = one(spark, legal.panel_type, court, said, case_no)
    assert got == want or (want == "panel" and got == "extended" and "rozhodl v rozšířeném" in said)


def test_panel_of_the_whole_heading(spark, monkeypatch):
    court = {"a": "NSS", "b": "NSS", "c": "US", "d": "US", "e": "NSS"}
    marked = {"a": (4, "rozhodl v rozšířeném senátu"), "b": (5, "rozhodl v rozšířeném senátu"), "c": (2, "plénum rozhodlo"), "d": (3, "plénum rozhodlo"), "e": (2, "věc se postupuje rozšířenému senátu")}
    rows = [(k, i + 1, k_at[1] if i == k_at[0] else f"odstavec {i}") for k, k_at in marked.items() for i in range(1, 7)]
    monkeypatch.setattr(plans, "_paragraphs", lambda s, d: spark.createDataFrame(rows, "doc string, paragraph_idx int, body string"))
    monkeypatch.setattr(plans, "decisions", lambda s, d: spark.createDataFrame([(k, v, "1/20") for k, v in court.items()], "ecli string, court_code string, case_no string"))
    assert {r.ecli: r.panel_type for r in plans.f20_panel_types(spark, "").collect()} == {"a": "extended", "b": "panel", "c": "plenary", "d": "panel", "e": "panel"}


def test_cases_by_document_key(spark):
    said = ["Pl. ÚS 44/2021", "Pl. ÚS 44/21", "Pl. ÚS 44/21", "IV. ÚS 5/20", "IV.ÚS 5/20", "XX. ÚS 1/20"]
    rows = spark.createDataFrame([(x,) for x in said], "spelling string")
    assert {tuple(r) for r in plans.case_histogram(rows).collect()} == {("Pl-44-21_1", "Pl. ÚS 44/21", 3), ("4-5-20_1", "IV. ÚS 5/20", 2)}


def test_case_histogram_has_every_mention(spark, data):
    from collections import Counter, defaultdict

    want = defaultdict(Counter)
    for r in spark.read.parquet(f"{data}/decision_paragraph.parquet").select("body").collect():
        for who, n, year in re.findall(r"sp\.\s*zn\.\s*(Pl|[IVX]+)\.?\s*ÚS\s+(\d+)/(\d{2,4})", r.body or "", re.A):
            k = {"Pl": "Pl", "I": "1", "II": "2", "III": "3", "IV": "4"}.get(who)
            if k:
                want[f"{k}-{n}-{year[-2:]}_1"][who] += 1
    got = plans.a19_case_histogram(spark, data).collect()
    assert {r.key: r.mentions for r in got} == {k: sum(c.values()) for k, c in want.items()} and got
    assert [(-r.mentions, r.key) for r in got] == sorted((-r.mentions, r.key) for r in got)


def test_decisions_are_dated_by_their_last_date(spark, data):
    from datetime import date

    from kodex.plans import more

    rows = spark.read.parquet(f"{data}/decision_paragraph.parquet").orderBy("ecli", "idx", "para_id").collect()
    bodies = {}
    for r in rows:
        bodies.setdefault((r.ecli, r.idx), r.body)
    want = {}
    for (ecli, _), body in sorted(bodies.items()):
        want.setdefault(ecli, None)
        plain = text_plain(body or "")
        if m := re.search(r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", body or "", re.A):
            d, mon, y = map(int, m.groups())
        elif (m := re.search(r"(\d{1,2})\.\s*([a-z]+)\s+(\d{4})", plain, re.A)) and m[2] in legal.MONTHS:
            d, mon, y = int(m[1]), legal.MONTHS[m[2]], int(m[3])
        else:
            continue
        try:
            want[ecli] = date(y, mon, d).isoformat()
        except ValueError:
            pass
    got = {r.ecli: r.dated_on for r in more.s20_decision_dates(spark, data).collect()}
    assert got == want and any(got.values())


def text_plain(s):
    import unicodedata

    return " ".join("".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).split()).lower()


@pytest.mark.parametrize("court,said,case_no,want", [
    ("NSS", "Plénum NSS rozhodlo", None, "plenary"), ("NSS", "7členný RS NSS", None, "extended"), ("NSS", "plénum rozhodlo", None, "panel"), ("NSS", "navrhuje na postoupení rozšířenému senátu", None, "panel"),
    ("NSS", "senát věc postupuje; " + "x" * 60 + " rozšířený senát rozhodl", None, "extended"), ("US", "přikázal to plénu", None, "plenary"), ("NSS", "přikázal to rozšířenému senátu", None, "panel"), ("NS", "rozšířený senát", None, "panel"),
])
def test_panels_by_each_courts_names(spark, court, said, case_no, want):
    assert one(spark, lambda a, b: legal.panel_type(a, b, F.lit(None).cast("string")), court, said) == want


def test_locate(spark):
    at = lambda t, n: [tuple(m) for m in (one(spark, text.locate, t, n) or [])]
    assert at("Viz §\xa05  a zase § 5, též Č. J. 1", "§ 5") == [("§\xa05", 4, 7), ("§ 5", 16, 19)]
    assert at("č. j. 1 As 2/2010 a Č.  J. 1 AS 2/2010", " č. j.  1 As 2/2010 ") == [("č. j. 1 As 2/2010", 0, 17), ("Č.  J. 1 AS 2/2010", 20, 38)]
    assert at("a.b a+b (a) \\E x", "a+b") == [("a+b", 4, 7)] and at("x \\E y", "\\E y") == [("\\E y", 2, 6)]
    assert at("abc", " ") == [] and at("abc", None) == [] and at(None, "a") == [] and at("aaaa", "aa") == [("aa", 0, 2), ("aa", 2, 4)]


def test_very_many_matches_and_sentences(spark):
    """More than a block of running sums holds, against Python's re."""
    body = " ".join(f"§ {i}. Věta {i} je tu. sp. zn. {i} As {i}/2010!" for i in range(1, 700))
    df = spark.createDataFrame([(body,)], "body string")
    got = df.select(find_all(F.col("body"), PATTERNS[5].regex, PATTERNS[5].groups).alias("m"), text.sentences(F.col("body")).alias("s"), extract.spans(F.col("body")).alias("x")).first()
    assert [(m.start, m.end) for m in got.m] == [m.span() for m in re.finditer(PATTERNS[5].regex, body, re.ASCII)]
    assert [tuple(s) for s in got.s] == plain_sentences(body)
    assert [(x.start, x.end, x.pattern_ord) for x in got.x] == [s[:3] for s in plain_spans(body)]
