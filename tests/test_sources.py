"""File readers, pages and streams."""

import json

import pytest
from pyspark.sql import functions as F

from kodex.schema import LABELS
from kodex.sources import files, pages
from kodex.streaming import incremental

RECORDS = [
    {"act_no": "89/2012", "section": "§ 1.", "subsec": "odst. (2)", "body": "b", "valid_from": "2020-01-01"},
    {"provision": {"act_no": "89/2012", "section": "2", "subsec": None}, "body": "b", "valid_from": "2020-01-01", "valid_to": "2021-01-01"},
    {"act_no": "89/2012", "section": "3", "body": "", "valid_from": "2020-01-01"},
    {"act_no": "x", "section": "3", "body": "b", "valid_from": "2020-01-01"},
    {"act_no": "89/2012", "section": "3", "body": "b", "valid_from": "soon"},
    {"act_no": "89/2012", "section": "3", "body": "b", "valid_from": "2020-01-01", "valid_to": "x"},
    {"act_no": "89/2012", "section": "3", "body": "b", "valid_from": "2020-01-01", "format": "xml"},
]


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n\n".join(map(json.dumps, RECORDS)))
    good, bad = files.dump_records(files.json_lines(spark, str(tmp_path / "a.jsonl")))
    assert sorted((r.section, r.subsec) for r in good.collect()) == [("1", "2"), ("2", None)]
    assert sorted(r.reason for r in bad.collect()) == ["foreign format", "no act number", "no body", "no valid_from", "valid_to is no day"]
    for name, doc in (("l", RECORDS), ("r", {"records": RECORDS}), ("g", {"@graph": RECORDS})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        assert files.json_document(spark, str(tmp_path / f"{name}.json")).count() == len(RECORDS)
    (tmp_path / "bad.jsonl").write_text('{"act_no": \n')
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    assert files.files_below(spark, str(tmp_path), ".json").count() == 3
    assert files.files_below(spark, str(tmp_path / "none"), ".json").count() == 0


def test_labels_and_golden(spark, tmp_path):
    (tmp_path / "l.csv").write_text("citing_ecli,cited_ecli,paragraph_idx,gold_label,note\n# c\na,b,1,FOLLOWED,\na,c,,QUASHED,x\nTEST-a,b,1,FOLLOWED,\na,b,1,ODD,\na,b,x,FOLLOWED,\n,b,1,FOLLOWED,\n")
    good, bad = files.gold_labels(spark, str(tmp_path / "l.csv"), LABELS)
    assert good.count() == 2 and sorted(r.problem for r in bad.collect()) == ["no key", "paragraph_idx is no number", "placeholder", "unknown label"]
    (tmp_path / "g.jsonl").write_text(json.dumps({"id": "1", "text": "viz § 5", "expected": [{"kind": "provision", "raw_text": "§ 5", "start": 4, "end": 7, "groups": {"section": "5"}}, {"kind": "provision", "raw_text": "§ 6", "start": 0, "end": 3, "groups": {}}]}))
    assert [r.ok for r in files.golden_spans(spark, str(tmp_path / "g.jsonl")).collect()] == [True, False]
    (tmp_path / "p.toml").write_text("[patterns.a]\nregex='x'\nkind='k'\ngroups=[]\n[patterns.b]\nregex='y'\nkind='k'\ngroups=['g']\n")
    assert [p["name"] for p in files.catalogue(str(tmp_path / "p.toml"))] == ["a", "b"]
    raw = spark.createDataFrame([("1/2000", json.dumps({"historie": [{"id": "w", "datumUcinnostiOd": "2020-01-01", "datumUcinnostiDo": None, "typ": "platne"}, {"id": "v", "datumUcinnostiOd": "2020-01-01", "typ": "vyhlasene"}]}))], "act_no string, reply string")
    assert [r.wording for r in files.history_entries(raw).collect()] == ["w"]


def test_pages(spark):
    html = "<html><head><title>x</title><style>p{}</style></head><body><h1>A&nbsp;b</h1><p class='x'>one<br/>two &sect; 5 &amp; 6</p><script>no()</script><div> </div><table><tr><td>1</td><td><b>Výrok<br>Zrušuje se.</b></td></tr><tr><td>x</td></tr></table></body></html>"
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id long, html string")
    assert [(r.idx, r.body) for r in pages.paragraphs(df, "id", "html").orderBy("idx").collect()][:3] == [(1, "A b"), (2, "one"), (3, "two § 5 & 6")]
    assert [r.cells for r in pages.table_rows(df, "id", "html", 2).collect()][0][0] == "1"
    assert df.select(pages.bold_verdict(F.col("html")).alias("v")).first().v == "Zrušuje se."
    p = spark.createDataFrame([("a", 1, "takto:"), ("a", 3, "I. Ruší se."), ("a", 4, "II. X"), ("a", 5, "Odůvodnění"), ("a", 6, "takto:"), ("b", 1, "nic"), ("c", 1, "takto:"), ("c", 2, "Y"), ("c", 3, "[1] z")], "ecli string, idx int, body string")
    assert {r.ecli: r.verdict_text for r in pages.verdicts(p).collect()} == {"a": "I. Ruší se.\nII. X", "c": "Y"}


def test_verdicts_as_each_court_opens_them(spark):
    long = "Ústavní soud rozhodl v senátu složeném z předsedy a soudců o ústavní stížnosti stěžovatele proti rozsudku Nejvyššího soudu, "
    cases = {
        "nalus:1-1-20_1": ["I. ÚS 1/20", long + "takto:", "Rozsudek se zrušuje.", "[1] dále", "Odůvodnění", "x"],
        "nalus:2-1-20_1": ["Nález", long + "t a k t o :", "I.", "V ý r o k", "II.", "Odůvodnění"],
        "nalus:3-1-20_1": ["a", "b", "c", "d", "e", "f", long + "takto:", "cizí výrok"],
        "nalus:4-1-20_1": ["Výrok se ruší", "b"],
        "ECLI:CZ:NSS:2020:1": ["1 As 1/2020", "[1] " + long + "takto:", "cizí", " " * 80 + "t a k t o :", "Zamítá se.", "O d ů v o d n ě n í", "x"],
        "ECLI:CZ:NS:2020:1": [long + "takto:", "Dovolání se odmítá.", "[1] x"],
    }
    rows = spark.createDataFrame([(k, i, b) for k, v in cases.items() for i, b in enumerate(v, 2)], "ecli string, idx int, body string")
    want = {"nalus:1-1-20_1": "Rozsudek se zrušuje.\n[1] dále", "nalus:2-1-20_1": "II.", "ECLI:CZ:NSS:2020:1": "Zamítá se.", "ECLI:CZ:NS:2020:1": "Dovolání se odmítá."}
    assert {r.ecli: r.verdict_text for r in pages.verdicts(rows).collect()} == want


def test_kept_latest_survives_restarts_and_late_rows(spark, tmp_path):
    source, schema = tmp_path / "in", "k int, v string, at int"
    kept = incremental.KeptLatest(spark, ["k"], ["at", "v"], str(tmp_path / "kept"))
    batches = [[(1, "a", 1), (2, "a", 1)], [(1, "b", 3), (3, "c", 1)], [(1, "late", 2), (2, "z", 9)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = kept.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    assert sorted(tuple(r) for r in out.collect()) == [(1, "b", 3), (2, "z", 9), (3, "c", 1)]
    again = incremental.KeptLatest(spark, ["k"], ["at", "v"], str(tmp_path / "kept2"))
    both = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    assert sorted(map(str, again.run(both).collect())) == sorted(map(str, out.collect()))


def test_kept_latest_goes_on_after_a_restart(spark, tmp_path):
    source, schema, folder = tmp_path / "in", "k int, v string, at int", str(tmp_path / "kept")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    fresh = lambda: incremental.KeptLatest(spark, ["k"], ["at", "v"], folder, buckets=4)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    put([(1, "a", 1), (2, "a", 1)])
    fresh().run(stream())
    put([(3, "c", 1)])
    assert got(fresh().run(stream())) == [(1, "a", 1), (2, "a", 1), (3, "c", 1)]
    assert got(fresh().run(stream())) == [(1, "a", 1), (2, "a", 1), (3, "c", 1)]  # nothing new
    kept = fresh()
    before, last = dict(kept.state["at"]), kept.state["number"]
    kept.fold(spark.createDataFrame([(1, "repeated", 9)], schema), last)  # a committed batch again
    assert got(kept.table()) == [(1, "a", 1), (2, "a", 1), (3, "c", 1)]
    kept.fold(spark.createDataFrame([(1, "b", 5)], schema), last + 1)
    assert sum(before[b] != kept.state["at"][b] for b in before) == 1  # only the bucket touched

    class Killed(Exception):
        pass

    def die(state):
        raise Killed

    broken = fresh()
    broken._commit = die
    with pytest.raises(Killed):  # written, not committed
        broken.fold(spark.createDataFrame([(2, "lost", 7)], schema), last + 2)
    again = fresh()
    assert got(again.table()) == [(1, "b", 5), (2, "a", 1), (3, "c", 1)]
    again.fold(spark.createDataFrame([(2, "kept", 7)], schema), last + 2)
    assert got(fresh().table()) == [(1, "b", 5), (2, "kept", 7), (3, "c", 1)]


def test_event_windows_of_many_files_in_no_order(spark, tmp_path):
    import os

    from kodex.plans import more

    spark.sql("select timestamp '2024-03-20' - make_interval(0, 0, 0, id) ts, 'a' event_type, 1.0D value from range(140)").coalesce(1).write.parquet(str(tmp_path / "all"))
    rows = spark.read.parquet(str(tmp_path / "all"))
    rows.repartitionByRange(140, F.desc("ts")).write.parquet(str(tmp_path / "events.parquet"))
    files_ = sorted((tmp_path / "events.parquet").glob("part-*"))
    assert len(files_) > 128  # rows are late from the third batch on
    for i, f in enumerate(files_):  # the latest days come first
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    got = more.stream_event_windows(spark, str(tmp_path)).collect()
    assert len(got) == 138 and all(r.n == 1 for r in got)


def test_repeats_within_watermark(spark, tmp_path):
    spark.sql("select id % 3 k, timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id) ts from range(9)").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "e"))
    assert incremental.drained(incremental.without_repeats(stream, ["k"], "ts")).count() == 3
