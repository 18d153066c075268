"""Wrong encodings and look-alike text: round trips, traps and odd cases."""

import random

import pytest

from kodex.llm import canonical, encoding
from kodex.llm import queries as q

CLEAN = "Příliš žluťoučký kůň úpěl ďábelské ódy před nejvyšším správním soudem v řízení o kasační stížnosti žalobce Částku Kč zjišťuje neboť důvodně rozhodčí".split()


def misread(word, chain):
    for stored, read in zip(chain[::2], chain[1::2]):
        data = word.encode(stored)
        word = data.decode(read, "replace") if read in ("utf-8", "ascii") else encoding.misread(data, read)
    return word


@pytest.mark.parametrize("chain", encoding.chains(), ids=">".join)
def test_forms_are_what_the_chain_gives(chain):
    for word in CLEAN + ["„přibližně“", "Łąkowo"]:
        try:
            form = misread(word, chain)
        except UnicodeEncodeError:
            continue
        if form != word and (len(form) > 1 or form == "�"):
            assert form in encoding.garble(word)
            back = encoding.ungarble(form, ">".join(chain))
            assert back in (None, word) and (back == word or "�" in form or chain[1] in ("utf-8", "ascii"))


FOREIGN = ["Łąkowo Średnie »Źródło«", "São Brás a Saint-Ânge", "JOÃO ÂNCORA", "là giù però caffè crème", "ľahký návěs „kĺzavá sadzba“", "Straßenfläche Übergabe", "фирма Ветерок", "&aacute;&nbsp;§ 5 m² ±2 °C"]
ROW = "table_name string, row_id long, text string, token string, words string"


@pytest.mark.parametrize("small", [True, False])
def test_garbled_rows_and_restored(spark, monkeypatch, small):
    if not small:
        from kodex import session

        monkeypatch.setattr(encoding, "lookup", lambda *a, **k: session.lookup(*a, **k, rows=-1))
        monkeypatch.setattr(encoding, "sized_broadcast", lambda df: df)
    rng = random.Random(1)
    sentence = lambda: " ".join(rng.choice(CLEAN) for _ in range(8))
    rows, bad, restorable = [], {}, {}
    for i in range(300):
        rows.append((i, sentence() + ". " + rng.choice(FOREIGN)))
    tried = [("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "cp1250"), ("cp1250", "cp1252"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("utf-8", "cp1250", "utf-8", "cp1250"), ("utf-8", "cp1252", "utf-8", "cp1252"), ("cp1250", "utf-8"), ("utf-8", "ascii")]
    for i in range(1000, 1060):
        a, b, chain = sentence(), f"důvodně {sentence()} zjišťuje", tried[i % len(tried)]
        garbled = misread(b, chain)
        if garbled != b:
            bad[i] = a + " " + b
            rows.append((i, a + " " + garbled))
            if chain[1] not in ("utf-8", "ascii"):
                restorable[i] = a + " " + b
    rows += [(2000, None), (2001, ""), (None, misread("řízení", ("utf-8", "cp1252")))]
    rows.append(rows[320])
    df = spark.createDataFrame([("t", i, x, "tok", "w") for i, x in rows], ROW)
    assert {r.row_id for r in encoding.garbled_rows(df).collect()} == set(bad)
    out = {r.row_id: r for r in encoding.restored(df).collect()}
    assert set(out) == set(bad)
    for i, want in restorable.items():
        assert out[i].restored == want, (out[i].text, want)
    assert encoding.garbled_rows(df.limit(0)).count() == 0 and encoding.restored(df.filter("row_id >= 2000")).count() == 0


def test_copies_of_a_garbled_text_weigh_as_one(spark):
    garbled = misread("žluťoučký", ("cp1250", "cp1252"))
    rows = [(1, "kůň žluťoučký"), (2, None), (3, None)] + [(i, f"x {garbled}") for i in range(10, 15)]
    df = spark.createDataFrame([("t", i, x) for i, x in rows], "table_name string, row_id long, text string")
    assert {r.row_id for r in encoding.garbled_rows(df).collect()} == set(range(10, 15))
    assert {r.token: r.n for r in encoding.vocabulary(df).collect()} == {"kůň": 1, "žluťoučký": 1, garbled: 1}


def test_rare_names_are_decoded_by_the_chain_of_their_row(spark):
    rows = [(i, "soudní řízení", "t") for i in range(5)] + [(9, misread("soudní řízení Halazaůvka", ("utf-8", "cp1250")), "t")]
    got = encoding.restored(spark.createDataFrame(rows, "row_id long, text string, table_name string")).collect()
    assert [r.restored for r in got] == ["soudní řízení Halazaůvka"]


def test_names_without_a_clean_twin_are_found_by_their_parts(spark):
    texts = [" ".join(CLEAN)] * 9 + ["obec " + misread("Kolaětín", c) for c in (("utf-8", "cp1252"), ("utf-8", "latin_1"), ("utf-8", "cp1250", "utf-8", "cp1250"), ("cp1250", "utf-8"))] + ["obec Kolaøtín", *FOREIGN]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "table_name string, row_id long, text string")
    assert {r.row_id for r in encoding.garbled_rows(rows).collect()} == {9, 10, 11, 12}
    assert {r.row_id: r.restored for r in encoding.restored(rows).collect()}[9] == "obec Kolaětín"


@pytest.mark.parametrize("text,want", [
    ("２０１４／３", "2014/3"), ("ﬁnanční", "finanční"), ("Ⅳ. ÚS", "IV. ÚS"), ("sрrávсe dаně", "správce daně"), ("č.\xa0j.　1", "č. j. 1"), ("ods‎t\xad. 6", "odst. 6"),
    ("2022−78‑1‐2", "2022-78-1-2"), ("společnost", "společnost"), ("ќ", "ќ"), ("е̌ x", "е̌ x"), ("žе̌", "žě"), ("Ⅷ", "VIII"), ("٣", "3"), ("", ""), ("a\tb\nc", "a\tb\nc"),
])
def test_ordinary(text, want):
    import unicodedata

    assert canonical.ordinary(text) == unicodedata.normalize("NFC", want)
    assert canonical.ordinary(canonical.ordinary(text)) == canonical.ordinary(text)


@pytest.mark.parametrize("text", ["фирма Ветерок", "ΚΑΛΗΜΕΡΙΑ", "α-karelin", "½ ku ¼…", "m² ±2 °C § ©", "„a“ ‚b‘ »c« – — … •", "Straße Łódź", "x\r\ny\tz", "日本"])
def test_ordinary_stays(text):
    assert canonical.ordinary(text) == text


def test_comparable():
    assert canonical.comparable(" Č.\xa0J. ２ Ads ") == "č. j. 2 ads" and canonical.comparable("STRASSE") == canonical.comparable("straße")


def test_operator_agrees_with_the_kernel(spark):
    texts = ["plain", "ž ř", "２", "a\x0bb", "x\xady", None, "", "„a“", "sрrávсe", "x" * 100000 + "\xa0", "naïve €5", "\x7f", "ĳ ŉ ſ"]
    df = spark.createDataFrame([("t", i, x, "f") for i, x in enumerate(texts)], "table_name string, row_id long, text string, form string")
    got = {r.row_id: r.form for r in canonical.differing(df).collect()}
    assert got == {i: canonical.ordinary(x) for i, x in enumerate(texts) if x and canonical.ordinary(x) != x}
    from pyspark.sql import functions as F

    for f, kernel in ((canonical.ordinary_form, canonical.ordinary), (canonical.comparison_key, canonical.comparable)):
        assert [r.x for r in df.orderBy("row_id").select(f(F.col("text")).alias("x")).collect()] == [x if x is None else kernel(x) for x in texts]
    assert canonical.differing(df.limit(0)).count() == 0


def test_links(spark):
    aliases = spark.createDataFrame([("1 As 2/2010", "a"), ("1\xa0As ２/2010", "a"), (None, "b"), ("x", "c")], "alias string, ecli string")
    cited = spark.createDataFrame([("č. j. 1 As 2/2010", "ref_no"), ("č.\xa0j. 1 Аs 2/2010", "ref_no"), ("§ 5", "provision"), (None, "ref_no")], "raw_text string, kind string")
    assert [tuple(r) for r in canonical.links(aliases, cited).collect()] == [("1 as 2/2010", 2, 1, 2)]


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, data, name, request):
    if name in q.ORACLE:
        got, want = request.getfixturevalue("compare")(q.QUERIES[name], q.ORACLE[name])
        assert got == want
    else:
        assert q.QUERIES[name](spark, data).count() >= 0
