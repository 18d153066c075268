"""The graph's rules on small hand-made rows: authority, hops, thresholds, versions, merges, routing, the gate."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kodex import schema
from kodex.operators import classify, document, evaluate, extract, graph, merge, status
from kodex.session import salted_join

def DAY():
    return F.lit("2020-06-30").cast("date")

TREATMENT = "citation_id long, citing_ecli string, cited_ecli string, citing_date date, citing_panel string, label string, confidence decimal(3,2), evidence_span string, may_depart boolean"
PROVISION = "ecli string, provision_id long, reworded boolean, changed_on date, material boolean, derogated_by string"

# Each case: treatments (label, confidence, day, may_depart), provisions (changed_on, reworded, material, derogated_by), red sources followed; the light and the kinds of reasons.
CASES = [
    ([], [], [], "GREEN", []),
    ([("QUASHED", "0.85", "2019-01-01", False)], [], [], "RED", ["Quashed"]),
    ([("QUASHED", "0.84", "2019-01-01", False)], [], [], "GREEN", []),
    ([("QUASHED", "1.00", "2020-06-30", False)], [], [], "RED", ["Quashed"]),
    ([("QUASHED", "1.00", "2020-07-01", False)], [], [], "GREEN", []),
    ([("DEPARTED", "0.85", "2019-01-01", True)], [], [], "RED", ["Superseded"]),
    ([("DEPARTED", "0.84", "2019-01-01", True)], [], [], "GREEN", []),
    ([("DEPARTED", "0.60", "2019-01-01", False)], [], [], "AMBER", ["Conflict"]),
    ([("DEPARTED", "0.59", "2019-01-01", False)], [], [], "GREEN", []),
    ([("NARROWED", "0.60", "2019-01-01", False)], [], [], "AMBER", ["Narrowed"]),
    ([("UNCLASSIFIED", "0.00", "2019-01-01", False)], [], [], "AMBER", ["NeedsReview"]),
    ([("FOLLOWED", "1.00", "2019-01-01", False), ("MENTIONED", "1.00", "2019-01-01", True)], [], [], "GREEN", []),
    ([], [(None, False, False, "x")], [], "RED", ["ProvisionDerogated"]),
    ([], [("2020-07-01", False, False, "x")], [], "GREEN", []),
    ([], [("2019-01-01", True, True, None)], [], "AMBER", ["ProvisionReworded"]),
    ([], [("2019-01-01", True, False, None), (None, True, True, None), ("2019-01-01", False, True, None)], [], "GREEN", []),
    ([], [], ["v"], "AMBER", ["InheritedWeakness"]),
    ([("NARROWED", "0.90", "2019-01-01", False), ("QUASHED", "0.90", "2020-01-01", False)], [("2019-01-01", True, True, None)], ["v"], "RED", ["Quashed", "Narrowed", "ProvisionReworded", "InheritedWeakness"]),
]


def test_truth_table(spark):
    t, p, h = [], [], []
    for i, (treatments, provisions, followed, _, _) in enumerate(CASES):
        t += [(j, f"c{j}", f"e{i}", date.fromisoformat(d), "panel", label, Decimal(conf), f"s{j}", may) for j, (label, conf, d, may) in enumerate(treatments)]
        p += [(f"e{i}", j, r, date.fromisoformat(c) if c else None, m, g) for j, (c, r, m, g) in enumerate(provisions)]
        h += [(f"e{i}", v) for v in followed]
    found = status.reasons(spark.createDataFrame(t + t, TREATMENT), spark.createDataFrame(p, PROVISION), spark.createDataFrame(h, "ecli string, via_ecli string"), DAY()).cache()
    keys = spark.createDataFrame([(f"e{i}",) for i in range(len(CASES))], "ecli string")
    lights = {r.ecli: (r.light, r.n_reasons) for r in status.lights(keys, found).collect()}
    kinds = {r.ecli: [x.kind for x in r.reasons] for r in status.ordered(found).collect()}
    for i, (*_, light, reasons) in enumerate(CASES):
        assert (lights[f"e{i}"], kinds.get(f"e{i}", [])) == ((light, len(reasons)), reasons), CASES[i]


def test_one_hop_only_and_order_of_reasons(spark):
    t = spark.createDataFrame([(1, "x", "C", date(2020, 1, 2), "panel", "QUASHED", Decimal("1.00"), "s", False), (2, "a", "C", date(2020, 1, 2), "panel", "QUASHED", Decimal("1.00"), "s", False), (3, "z", "C", date(2020, 1, 1), "panel", "QUASHED", Decimal("1.00"), "s", False)], TREATMENT)
    follows = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "citing_ecli string, cited_ecli string")
    lights, reasons = status.standing(spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "ecli string"), t, spark.createDataFrame([], PROVISION), follows, DAY())
    assert {r.ecli: r.light for r in lights.collect()} == {"A": "GREEN", "B": "AMBER", "C": "RED", "D": "GREEN"}
    assert [x.by_ecli for r in status.ordered(reasons).collect() if r.ecli == "C" for x in r.reasons] == ["z", "a", "x"]


def test_treatments_for(spark):
    decisions = spark.createDataFrame([("a", "NSS", "extended", date(2020, 1, 1)), ("b", "NSS", "panel", date(2019, 1, 1)), ("u", "US", "unknown", date(2020, 1, 1))], "ecli string, court_code string, panel_type string, decided_on date")
    citations = spark.createDataFrame([(1, "a", "b", 1), (2, "u", "b", 1), (3, "a", "a", 1), (4, "a", None, 1), (5, "gone", "b", 1), (6, "b", "b2", None)], "id long, citing_ecli string, cited_ecli string, paragraph_idx int")
    labels = spark.createDataFrame([(1, 1, "FOLLOWED", "v1", date(2020, 1, 1)), (2, 1, "odd", "v2", date(2020, 1, 1)), (3, 2, "DEPARTED", "v1", date(2020, 1, 1)), (4, 3, "QUASHED", "v1", date(2020, 1, 1))], "id long, citation_id long, label string, prompt_version string, created_at date").withColumn("confidence", F.lit(1)).withColumn("evidence_span", F.lit("s"))
    got = sorted((r.citation_id, r.label, r.may_depart) for r in graph.treatments_for(citations, labels, decisions, schema.authority(spark)).collect())
    assert got == [(1, "UNCLASSIFIED", True), (2, "DEPARTED", False)]
    assert graph.treatments_for(citations.limit(0), labels.limit(0), decisions.limit(0), schema.authority(spark)).count() == 0


def test_salted_join_is_a_join(spark, monkeypatch):
    from kodex import session

    monkeypatch.setattr(session, "PLAIN_BYTES", -1)
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice(["hot"] * 50 + [None, *map(str, range(40))]), i) for i in range(2000)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = salted_join(left, right, ["k"], how), left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), how


def test_timeline_and_merge_are_idempotent(spark):
    schema_ = "provision_id long, body string, valid_from date, valid_to date, derogated_by string"
    day = lambda n: date(2020, 1, n) if n else None
    records = spark.createDataFrame([(1, "a", day(1), None, None), (1, "a", day(3), None, None), (1, "b", day(5), day(7), None), (1, "c", day(10), None, "x"), (2, "a", day(1), None, None), (2, "b", day(1), None, None), (3, "a", day(9), day(2), None)], schema_)
    built = merge.timeline(records)
    assert sorted((r.valid_from.day, r.valid_to and r.valid_to.day, r.body) for r in built.collect()) == [(1, 4, "a"), (5, 7, "b"), (10, None, "c")]
    assert sorted((r.provision_id, r.reason) for r in merge.timeline_refusals(records).collect()) == [(2, "same start"), (3, "inverted")]
    old = built.withColumn("id", F.monotonically_increasing_id())
    assert {r.action for r in merge.timeline_actions(old, built).collect()} == {"unchanged"}
    new = spark.createDataFrame([(1, "a", day(1), day(4), None), (1, "B", day(5), day(7), None), (1, "d", day(20), None, None)], schema_)
    assert sorted(r.action for r in merge.timeline_actions(old, new).collect()) == ["delete", "insert", "unchanged", "update"]
    assert merge.timeline(records.limit(0)).count() == 0


def test_upserts(spark):
    schema_ = "ecli string, court_code string, panel_type string, ratio_summary string, source_url string, fetched_at date"
    old = spark.createDataFrame([("a", "US", "panel", "kept", "u", date(2020, 1, 1)), ("b", "US", "panel", None, "u", date(2020, 1, 1))], schema_)
    new = spark.createDataFrame([("a", "US", "plenary", None, "u", date(2021, 1, 1)), ("c", "NS", "panel", "r", "u", date(2021, 1, 1))], schema_)
    once = merge.upsert_decisions(old, new)
    assert sorted((r.ecli, r.panel_type, r.ratio_summary) for r in once.collect()) == [("a", "plenary", "kept"), ("b", "panel", None), ("c", "panel", "r")]
    assert sorted(map(str, merge.upsert_decisions(once, new).collect())) == sorted(map(str, once.collect()))
    aliases = spark.createDataFrame([("X\xa0 1", "case_no", "a", 2), ("x 1", "ref_no", "b", 1), (" ", "ref_no", "b", 3), (None, "ref_no", "b", 4)], "alias string, alias_kind string, ecli string, alias_id long")
    assert [tuple(r) for r in merge.first_writer(aliases).collect()] == [("x 1", "ref_no", "b")]
    known = spark.createDataFrame([(5, "1/2000", "1", None)], "id long, act_no string, section string, subsec string")
    wanted = spark.createDataFrame([("1/2000", "1", None), ("1/2000", "1", "2"), ("1/2000", "1", "2"), ("1/2000", "3", None)], "act_no string, section string, subsec string")
    got = merge.find_or_insert(known, wanted)
    assert sorted(r.id for r in got.collect()) == [5, 6, 7]
    assert merge.find_or_insert(got, wanted).count() == 3
    assert merge.insert_ignore(known, known, ["act_no", "section", "subsec"], ["id"]).count() == 1


def test_windows_across_runs(spark, monkeypatch):
    monkeypatch.setattr(graph, "CUT", 3)
    idx = [1, 2, 5, 6, 7, 8, 20, 21, 22, 23, 24]
    got = {r.idx: (r.context, r.focus) for r in graph.context_windows(spark.createDataFrame([("a", i, str(i)) for i in idx], "ecli string, idx int, body string")).collect()}
    assert got == {i: ([str(x) for x in idx[max(0, n - 2) : n + 3]], min(n, 2)) for n, i in enumerate(idx)}
    assert graph.context_windows(spark.createDataFrame([], "ecli string, idx int, body string")).count() == 0


def test_overlaps_and_windows(spark):
    v = spark.createDataFrame([(1, 1, date(2000, 1, 1), None), (1, 2, date(2019, 1, 1), date(2019, 2, 1)), (1, 3, date(2019, 2, 1), None), (2, 4, date(2000, 1, 1), date(1999, 1, 1)), (2, 5, date(2000, 1, 2), None), (3, 6, None, None)], "provision_id long, id long, valid_from date, valid_to date")
    assert sorted((r.earlier_id, r.later_id) for r in graph.overlaps(v, 100).collect()) == [(1, 2), (1, 3), (2, 3)]
    p = spark.createDataFrame([("a", i * 300, f"p{i}") for i in range(6)] + [("b", 1, "x")], "ecli string, idx int, body string")
    got = {(r.ecli, r.idx): (r.context, r.focus) for r in graph.context_windows(p).collect()}
    assert got["a", 0] == (["p0", "p1", "p2"], 0) and got["a", 600] == (["p0", "p1", "p2", "p3", "p4"], 2) and got["a", 1500] == (["p3", "p4", "p5"], 2) and got["b", 1] == (["x"], 0)
    c = extract.preceding_context(spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("a", 3, "y"), ("a", 6, "z")], "doc string, paragraph_idx int, body string"))
    assert {r.paragraph_idx: r.context for r in c.collect()} == {1: "", 2: "x", 3: "x", 6: "y"}


EDGE = "id int, citing_panel string, citing_date date, cited_date date, raw_text string, context array<string>, focus int, verdict_text string, cited_names array<string>"


@pytest.mark.parametrize("change,want", [
    ({}, ("triage", "FOLLOWED", "0.80", "Soud vyšel z č. j. 1 As 2/2010-7.")),
    ({"context": ["Jinak. Žalobce odkazuje na č. j. 1 As 2/2010-7. Soud."]}, ("structural", "MENTIONED", "0.95", "Žalobce odkazuje na č. j. 1 As 2/2010-7.")),
    ({"context": ["Žalobce odkazuje na zákon. Soud vyšel z č. j. 1 As 2/2010-7."]}, ("triage", "FOLLOWED", "0.80", "Soud vyšel z č. j. 1 As 2/2010-7.")),
    ({"verdict_text": "Rozsudek 1 As 2/2010-7 se ruší."}, ("structural", "QUASHED", "1.00", "Rozsudek 1 As 2/2010-7 se ruší.")),
    ({"verdict_text": "Rozsudek 1 As 2/2010-7 se odmítá. Rozhodnutí se ruší."}, ("triage", "FOLLOWED", "0.80", None)),
    ({"verdict_text": "Rozsudek 1 As 2/2010-7 se ruší.", "cited_date": date(2030, 1, 1)}, ("triage", "FOLLOWED", "0.80", None)),
    ({"verdict_text": "Rozsudek 1 As 2/2010-7 se ruší.", "cited_date": None}, ("triage", "FOLLOWED", "0.80", None)),
    ({"citing_panel": "extended"}, ("reasoning", None, None, "panel_type")),
    ({"context": ["Soud vyšel z č. j. 1 As 2/2010-7.", "Od toho je nutno odchýlit se."]}, ("reasoning", None, None, "departure_marker")),
    ({"context": ["Soud vyšel z č. j. 1 As 2/2010-7. To zde nedopadá."]}, ("reasoning", None, None, "narrowing_marker")),
    ({"context": ["nic"]}, ("reasoning", None, None, "low_confidence")),
    ({"context": []}, ("reasoning", None, None, "low_confidence")),
    ({"raw_text": " "}, ("reasoning", None, None, "low_confidence")),
])
def test_route(spark, change, want):
    base = {"id": 1, "citing_panel": "panel", "citing_date": date(2020, 1, 1), "cited_date": date(2010, 1, 1), "raw_text": "č. j. 1 As 2/2010-7", "context": ["Soud vyšel z č. j. 1 As 2/2010-7."], "focus": 0, "verdict_text": None, "cited_names": ["1 As 2/2010-7", ""]}
    r = classify.route(spark.createDataFrame([tuple((base | change).values())], EDGE)).first()
    assert (r.route, r.label, r.confidence and str(r.confidence)) == want[:3]
    assert want[3] is None or want[3] in (r.evidence_span, r.reason)


def test_gate(spark):
    replies = ['{"label":"FOLLOWED","confidence":0.876,"evidence_span":"ab  c"}', '{"label":"UNCLASSIFIED","confidence":1,"evidence_span":"a"}', '{"label":"FOLLOWED","confidence":"0.9","evidence_span":"a"}', '{"label":"FOLLOWED","confidence":true,"evidence_span":"a"}', '{"label":"FOLLOWED","confidence":-0.1,"evidence_span":"a"}', '{"label":"FOLLOWED","confidence":1,"evidence_span":" "}', '{"label":"FOLLOWED","confidence":1,"evidence_span":"AB"}', "no json", None]
    df = spark.createDataFrame([(i, r, "x ab c y") for i, r in enumerate(replies)], "i int, reply string, ctx string")
    got = [r.v for r in df.select("i", classify.violation(F.col("reply"), F.col("ctx")).alias("v")).orderBy("i").collect()]
    assert got[0] is None and [g.split(":")[0] for g in got[1:]] == ["label", "confidence", "confidence", "confidence", "evidence_span", "evidence_span", "label", "label"]
    edges = spark.createDataFrame([("k", "x ab c y", "f"), ("m", "x", "f"), ("n", "x", "f")], "cache_key string, context_text string, fallback_span string")
    tries = spark.createDataFrame([("k", 1, replies[6]), ("k", 2, replies[0]), ("m", 1, replies[0]), ("m", 2, replies[0]), ("m", 3, '{"label":"FOLLOWED","confidence":1,"evidence_span":"x"}')], "cache_key string, attempt int, reply string")
    assert sorted(map(str, (tuple(r)[0:1] + tuple(r)[3:] for r in classify.judged(edges, tries).collect()))) == sorted(map(str, [("k", "FOLLOWED", Decimal("0.88"), "ab c"), ("m", "UNCLASSIFIED", Decimal("0.00"), "f"), ("n", "UNCLASSIFIED", Decimal("0.00"), "f")]))


def test_resolution(spark):
    rows = spark.createDataFrame([("d", 1, "§ 5. Dále § 6 zákona č. 1/2000 Sb."), ("d", 9000, "§ 7 a č. j. 1 As 2/2010-7, též č. j. 1 As 3/2010"), ("e", 1, "§ 1"), ("f", 1, None), ("g", 1, "§ 2 b. § 3 zákona č. 2/2000 Sb., § 3 zákona č. 3/2000 Sb.")], "doc string, paragraph_idx int, body string")
    refs = extract.references(rows)
    acts = {(r.doc, r.raw_text): (r.act_no, r.basis) for r in extract.carry_acts(refs).collect()}
    assert acts["d", "§ 5"] == ("1/2000", "document-mode") and acts["d", "§ 7"] == ("1/2000", "backward-scan") and acts["e", "§ 1"] == (None, None) and acts["g", "§ 2"] == ("2/2000", "document-mode")
    aliases = spark.createDataFrame([("1 as 2/2010", "bare"), ("1 as 3/2010", "x")], "alias string, ecli string")
    keys = ["doc", "paragraph_idx", "span_start"]
    plain = {r.raw_text: r.resolved_ecli for r in extract.resolve_decisions(refs.filter("kind <> 'provision'"), aliases, keys).collect()}
    assert plain == {"č. j. 1 As 2/2010-7": None, "č. j. 1 As 3/2010": "x"}
    bare = {r.raw_text: r.resolved_ecli for r in extract.resolve_decisions(refs.filter("kind <> 'provision'"), aliases, keys, bare_fallback=True).collect()}
    assert bare["č. j. 1 As 2/2010-7"] == "bare"
    docs = document.document_paragraphs(spark.createDataFrame([(1, "§ 6 zákona č. 1/2000 Sb.\n\n§ 6 zákona č. 1/2000 Sb. a § 9"), (2, None), (3, "")], "doc_id long, text string"))
    found, missing = document.cited_targets(docs, aliases, spark.createDataFrame([(4, "1/2000", "6", None)], "id long, act_no string, section string, subsec string"))
    assert [(r.doc_id, r.ord, r.provision_id, r.mentions) for r in found.collect()] == [(1, 1, 4, 2)] and [r.raw_text for r in missing.collect()] == ["§ 9"]
    said = extract.back_references(spark.createDataFrame([("d", 1, "Z citovaného rozhodnutí plyne. Z citovaného rozhodnutí č. j. 1 As 2/2010 též.")], "doc string, paragraph_idx int, body string"), extract.references(spark.createDataFrame([("d", 1, "Z citovaného rozhodnutí plyne. Z citovaného rozhodnutí č. j. 1 As 2/2010 též.")], "doc string, paragraph_idx int, body string")))
    assert [r.sentence for r in said.collect()] == ["Z citovaného rozhodnutí plyne."]


def test_scores(spark):
    s = spark.createDataFrame([("QUASHED", "QUASHED", True), ("DEPARTED", "NARROWED", True), ("DEPARTED", "(none)", False), ("FOLLOWED", "DEPARTED", True)], "gold_label string, predicted string, may_depart boolean")
    assert {r.label: (r.tp, r.fp, r.fn, r.recall) for r in evaluate.label_scores(s).collect()} == {"QUASHED": (1, 0, 0, 1.0), "DEPARTED": (0, 1, 2, 0.0), "NARROWED": (0, 1, 0, None), "FOLLOWED": (0, 0, 1, 0.0)}
    assert tuple(evaluate.cluster_scores(s).first()) == (2, 0, 1, 1, 1, 0.0)
    assert tuple(evaluate.red_scores(s).first())[:3] == (1, 1, 1)
    assert tuple(evaluate.cluster_scores(s.limit(0)).first()) == (0, 0, 0, 0, 0, None)
    assert evaluate.confusion(s).count() == 3


def test_ask_a_model(spark):
    from kodex.operators import model
    from kodex.session import ship

    ship(spark)
    edges = spark.createDataFrame([("k", "say x", "x y", "f"), ("k", "say x", "x y", "f"), ("m", "say z", "x y", "f"), ("n", "never", "x y", "f"), ("c", "cached", "x y", "f")], "cache_key string, prompt string, context_text string, fallback_span string")

    def call(prompt):
        span = "x" if "x" in prompt.split("\n")[0] or "rejected" in prompt and "never" not in prompt else "nowhere"
        return '{"label": "FOLLOWED", "confidence": 0.9, "evidence_span": "%s"}' % span

    prompts = model.unasked(edges, edges.filter("cache_key = 'c'"))
    assert prompts.count() == 3
    replies = model.ask(prompts, call)
    assert sorted((r.cache_key, r.attempt) for r in replies.collect()) == [("k", 1), ("m", 1), ("m", 2), ("n", 1), ("n", 2)]
    got = {r.cache_key: r.label for r in classify.judged(edges, replies).collect()}
    assert got == {"k": "FOLLOWED", "m": "FOLLOWED", "n": "UNCLASSIFIED", "c": "UNCLASSIFIED"}


def test_a_broadcast_is_sized_by_bytes(spark, monkeypatch):
    from kodex import session

    small = session.stage(spark.range(100).selectExpr("id", "repeat('x', 1000) t"))
    assert session.is_small(small) and session.is_small(small.select("id"))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 50_000)
    assert not session.is_small(small) and not session.is_small(small.withColumn("u", F.col("t")))
    assert session.is_small(small.select("id")) and not session.is_small(small.select("id"), rows=99)


def test_staged_tables_are_released(spark):
    from kodex import session

    kept = session.stage(spark.range(5))
    assert kept.count() == 5
    session.release(spark)
    files, path = session.hadoop_path(spark, session.staged_dir(spark))
    assert not files.exists(path)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from kodex import session

    nothing = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: nothing, getCheckpointDir=lambda: None, applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(cluster)


def test_overlaps_are_counted_without_pairs(spark):
    rng = random.Random(4)
    day = lambda n: None if n is None else date(2000, 1, 1).fromordinal(730120 + n)
    rows = [(rng.randrange(3), i, day(rng.randrange(40)), day(rng.choice([None, *range(60)]))) for i in range(120)] + [(9, 500, None, None)]
    v = spark.createDataFrame(rows, "provision_id long, id long, valid_from date, valid_to date")
    links = {i: sum(q == p and a and f and a < f and (b is None or b >= f) for q, _, a, b in rows) for p, i, f, _ in rows if f}
    assert {r.id: r.links for r in graph.overlap_classes(v).collect()} == links
    pairs = graph.overlaps(v).groupBy("provision_id").count().collect()
    assert {r.provision_id: r.n for r in graph.timeline_problems(v).filter("problem = 'overlap'").collect()} == {r.provision_id: r["count"] for r in pairs}
    assert graph.overlap_classes(v.limit(0)).count() == 0


def test_judged_versions_hold_a_timeline(spark):
    schema_ = "provision_id long, body string, valid_from date, valid_to date, derogated_by string"
    new = spark.createDataFrame([(p, "a", date(2020, 1, 1), None, None) for p in (1, 2)], schema_)
    old = spark.createDataFrame([(p, "b", date(2020, 1, d), None, None, 10 * p + d) for p in (1, 2) for d in (1, 5)], schema_ + ", id long")
    named = spark.createDataFrame([(3, 15), (11, 12)], "from_version_id long, to_version_id long")
    got = sorted((r.provision_id, r.action) for r in merge.timeline_actions(old, new, named).collect())
    assert got == [(1, "refused"), (1, "refused"), (2, "delete"), (2, "update")]
    assert [r.id for r in merge.referenced_versions(merge.timeline_actions(old, new), named).collect()] == [15]
    up = merge.upsert(spark.createDataFrame([(1, None, "a"), (2, 2, "b")], "k int, j int, v string"), spark.createDataFrame([(1, None, "x"), (1, None, "y"), (3, 1, "z")], "k int, j int, v string"), ["k", "j"], ["v"])
    assert sorted(map(str, map(tuple, up.collect()))) == sorted(map(str, [(1, None, "y"), (2, 2, "b"), (3, 1, "z")]))
    s = spark.createDataFrame([("g", 0, "a"), ("g", 1, "a"), ("g", 1, "b"), ("g", 2, "c"), ("h", 0, "a"), ("z", 0, "a")], "g string, pass int, k string")
    t = spark.createDataFrame([("g", 2), ("h", 5), ("z", 0)], "g string, total int")
    assert sorted(tuple(r) for r in merge.samples_until(s, t, "g", "k").collect()) == [("g", "a", 0), ("g", "b", 1), ("h", "a", 0)]


def test_the_loop_checks_its_cache_again(spark):
    from kodex.operators import model
    from kodex.session import ship

    ship(spark)
    prompts = spark.createDataFrame([("kept", "say x", "x y"), ("stale", "say y", "x y"), ("never", "never", "x y"), ("new", "say z", "x y"), (None, "say x", "x")], "cache_key string, prompt string, context_text string")
    good = lambda span: '{"label": "FOLLOWED", "confidence": 0.9, "evidence_span": "%s"}' % span
    cache = spark.createDataFrame([("kept", good("gone"), date(2020, 1, 1)), ("kept", good("x"), date(2021, 1, 1)), ("stale", good("gone"), date(2021, 1, 1)), ("other", good("x"), date(2021, 1, 1))], "cache_key string, reply string, created_at date")

    def call(prompt):
        if prompt.startswith("say x"):
            raise RuntimeError("asked although the cache has it")
        return '{"label": "FOLLOWED", "confidence": 0.9, "evidence_span": "%s"}' % ("y" if prompt.startswith("say") and ("say y" in prompt or "rejected" in prompt) else "nowhere")

    answers, rejected = model.answered(prompts, cache, call)
    assert {r.cache_key: r.attempt for r in answers.collect()} == {"kept": 0, "stale": 1, "new": 2}
    assert [(r.cache_key, r.violation) for r in rejected.collect()] == [("never", "evidence_span: not in the context: nowhere")]
    none, bad = model.answered(prompts.limit(0), cache, call)
    assert none.count() == 0 and bad.count() == 0
