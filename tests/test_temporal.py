"""As-of lookups, histories and coverage against brute force, and their odd cases."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from kodex.operators import asof, history, sweep

DAY0 = date(2020, 1, 1)
D = lambda n: None if n is None else DAY0 + timedelta(days=n)
OPEN = "9999-12-31"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def covered(spans, horizon):
    return [any(f is not None and f <= d and (t is None or t >= d) and (t is None or t >= f) for f, t in spans) for d in range(horizon)]


@pytest.mark.parametrize("seed", range(4))
def test_coverage_is_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(e, rng.randrange(60), rng.choice([None, *range(-5, 30)])) for e in range(6) for _ in range(rng.randrange(7))]
    data = [(e, f, None if n is None and e % 2 else f + (n if n is not None else 3)) for e, f, n in data]
    data += data[:3]
    df = spark.createDataFrame([(e, D(f), D(t)) for e, f, t in data], "e int, f date, t date")
    got = rows(sweep.coverage(df, "e", "f", "t"))
    want = []
    for e in {x[0] for x in data}:
        spans = [(f, t) for x, f, t in data if x == e]
        days, is_open = covered(spans, 200), any(t is None for f, t in spans)
        edges = [i for i in range(200) if i == 0 or days[i] != days[i - 1]] + [200]
        runs = [(a, b - 1, days[a]) for a, b in zip(edges, edges[1:])]
        runs = [r for i, r in enumerate(runs) if r[2] or (0 < i < len(runs) - 1)]
        for a, b, on in runs:
            want.append((e, "period" if on else "gap", str(D(a)), OPEN if on and is_open and b == 199 else str(D(b))))
    assert got == sorted(want)


def test_coverage_odd_cases(spark):
    schema = "e int, f date, t date, _day int, kind string"
    df = spark.createDataFrame([(1, None, D(4), 1, "x"), (2, D(5), D(3), 1, "x"), (None, D(1), D(2), 1, "x"), (3, D(1), D(2), 1, "x"), (3, D(3), None, 1, "x")], schema)
    assert sorted(map(str, sweep.coverage(df, "e", "f", "t").collect())) == sorted(map(str, spark.createDataFrame([(None, "period", str(D(1)), str(D(2))), (3, "period", str(D(1)), OPEN)], "e int, kind string, day_from string, day_to string").collect()))
    assert sweep.coverage(df.limit(0), "e", "f", "t").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_winners_are_brute_force(spark, seed):
    rng = random.Random(seed)
    versions = []
    for i in range(60):
        f = rng.randrange(900)
        versions.append((rng.randrange(5), i, f, rng.choice([None, f + rng.randrange(-10, 400)]), f + rng.randrange(-30, 200)))
    versions.append((1, 100, None, None, 3))
    versions.append((1, 101, 5, None, None))
    events = [(rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice([None, *range(-20, 1200, 3)])) for _ in range(300)]
    v = spark.createDataFrame([(e, i, D(f), D(t), D(k), "x") for e, i, f, t, k in versions], "e int, id long, f date, t date, k date, _b string")
    d = spark.createDataFrame([(e, D(n)) for e, n in events], "e int, day date")
    got = {(r.e, r.day): r.id for r in asof.winners(v, d, "e", "f", "t", "k", "id", bucket_days=50).collect()}
    want = {}
    for e, n in events:
        if e is None or n is None:
            continue
        hit = [(f, k, i) for x, i, f, t, k in versions if x == e and f is not None and k is not None and f <= n and k <= n and (t is None or t >= n)]
        if hit:
            want[e, D(n)] = max(hit)[2]
    assert got == want


@pytest.mark.parametrize("small", [True, False])
def test_known_provisions_odd_cases(spark, monkeypatch, small):
    if not small:  # as if every table were too large to be broadcast
        from kodex import session

        monkeypatch.setattr(asof, "lookup", lambda *a, **k: session.lookup(*a, **k, rows=-1))
    contexts = spark.createDataFrame([(1, "a", D(50)), (1, "a", D(50)), (2, "gone", D(50)), (3, None, D(1)), (4, "a", None)], "request_id long, ecli string, as_of date")
    refs = spark.createDataFrame([("a", 7), ("a", 7), ("a", None), (None, 7), ("b", 8), ("gone", 7)], "ecli string, resolved_provision_id long")
    decisions = spark.createDataFrame([("a", D(10)), ("a", D(10)), ("b", D(1))], "ecli string, decided_on date")
    versions = spark.createDataFrame([(70, 7, D(0), D(20), D(0)), (71, 7, D(21), None, D(45))], "id long, provision_id long, valid_from date, valid_to date, recorded_on date")
    assert rows(asof.known_provisions(contexts, refs, decisions, versions)) == [(1, 7, 70, 71), (2, 7, 0, 71), (4, 7, 70, 0)]
    empty = [x.limit(0) for x in (contexts, refs, decisions, versions)]
    assert asof.known_provisions(*empty).count() == 0
    assert rows(asof.known_provisions(contexts, refs, decisions, empty[3])) == [(1, 7, 0, 0), (2, 7, 0, 0), (4, 7, 0, 0)]


DUMP = "rec_id long, dump_on date, act_no string, section string, subsec string, body string, valid_from date, valid_to date, derogated_by string"


def history_of(spark, records, every=2):
    dumps = spark.createDataFrame([(i, D(d), "1/2000", "5", s, b, D(f), D(t), g) for i, (d, s, b, f, t, g) in enumerate(records)], DUMP)
    provisions = spark.createDataFrame([(1, "1/2000", "5", None), (2, "1/2000", "5", "1")], "id long, act_no string, section string, subsec string")
    return rows(history.provision_history(dumps, provisions, every))


def test_history(spark):
    got = history_of(spark, [
        (0, "", "a", 0, None, None), (9, None, "a", 0, 5, None),  # put right later: ends on 5
        (1, "", "b", 10, None, None), (2, "", " b  ", 20, 99, None),  # the same wording, spaced differently
        (3, "", "c", 30, None, None), (4, "", "c", 40, None, "x"),  # derogated: another row
        (5, "1", "z", 3, 2, None), (6, "1", None, 4, None, None), (6, "1", None, 8, None, None),  # void; null bodies are equal
        (7, "9", "no such provision", 1, None, None),
    ])
    day = lambda n: str(D(n))
    assert got == sorted([(1, day(0), day(5)), (1, day(10), day(29)), (1, day(30), day(39)), (1, day(40), OPEN), (2, day(4), OPEN)])


def test_history_keeps_gaps_between_equal_wordings(spark):
    got = history_of(spark, [(0, "", "a", 0, 4, None), (0, "", "a", 10, None, None)])
    assert [x[2] for x in got] == [str(D(4)), OPEN]


@pytest.mark.parametrize("every", [1, 2, 3, 8])
def test_patches_fold_back(spark, every):
    rng = random.Random(every)
    versions = spark.createDataFrame([(k, D(i), rng.choice(["x", "y", None]), rng.choice([None, D(5)])) for k in range(4) for i in range(20)], "k int, f date, body string, t date")
    patches = history.to_patches(versions, ["k"], "f", ["body", "t"], every)
    assert rows(history.from_patches(patches, ["k"], "f", ["body", "t"]).select("k", "f", "body", "t").na.fill("-")) == rows(versions.na.fill("-"))
    assert patches.filter("is_full").count() == 4 * -(-20 // every)
    assert history.from_patches(patches.limit(0), ["k"], "f", ["body", "t"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_history_store_is_what_all_dumps_say(spark, tmp_path, seed):
    """Dumps appended one by one, late and corrected records among them, give what settling all of them at once gives."""
    rng = random.Random(seed)
    columns = "k string, f date, t date, body string, dump int, rec int, extra string"
    day = lambda n: date(2000, 1, 1) + timedelta(days=n)
    records = [(rng.choice(["a"] * 6 + ["b", "c", None]), day(rng.randrange(90)), rng.choice([None, day(rng.randrange(100))]), rng.choice(["x", "y", None]), d, i, "e") for i, d in enumerate(sorted(rng.randrange(5) for _ in range(160)))]
    store = history.HistoryStore(spark, str(tmp_path / "store"), ["k"], "f", "t", ["dump", "rec"], ["body"], every=4)
    for d in range(5):
        store = history.HistoryStore(spark, str(tmp_path / "store"), ["k"], "f", "t", ["dump", "rec"], ["body"], every=4)
        store.append(spark.createDataFrame([r for r in records if r[4] == d], columns))
    store.append(spark.createDataFrame([], columns))
    whole = spark.createDataFrame(records, columns)
    want = history.settle(whole, ["k"], "f", "t", ["dump", "rec"], ["body"]).select("k", "f", "t", "body")
    text = lambda df: sorted(map(str, df.select("k", "f", "t", "body").collect()))
    assert text(store.versions()) == text(want)
    best = {}
    for r in want.collect():
        if r.f <= day(45) and (r.k not in best or r.f > best[r.k].f):
            best[r.k] = r
    assert text(store.latest_by(F.lit("2000-02-15").cast("date"))) == sorted(map(str, best.values()))
    per = {}
    for r in store.patches().collect():
        per.setdefault((r.k, r.segment), []).append((r.f, r.is_full))
    assert all(sorted(v)[0][1] and sum(full for _, full in v) == 1 and len(v) <= 4 for v in per.values())
