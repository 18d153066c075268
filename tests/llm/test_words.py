"""Leakage, splitting, mixing and recurring lines against brute force."""

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from kodex.llm import boilerplate, leakage, mixing, splitting
from kodex.llm.flow import Flow
from kodex.llm.words import winnow, word_hashes


def plain_words(text):
    out, cur = [], []
    for ch in unicodedata.normalize("NFD", text):
        kind = unicodedata.category(ch)[0]
        if kind in "LN":
            cur.append(ch.casefold())
        elif kind != "M" and cur:
            out.append("".join(cur))
            cur = []
    return out + (["".join(cur)] if cur else [])


def test_word_hashes_tell_words_apart():
    texts = ["Příliš, žluťoučký KŮŇ-x1", "", "prilis zlutoucky kun x1", "— …", "příliš", "příliš", "a" * 50000]
    h, at = word_hashes(texts)
    assert list(np.diff(at)) == [len(plain_words(t)) for t in texts]
    per = [h[a:b].tolist() for a, b in zip(at, at[1:])]
    assert per[0] == per[2] and per[4] == per[5] and len(set(per[0])) == 4


@pytest.mark.parametrize("seed", range(3))
def test_winnowing_keeps_a_shared_fingerprint(seed):
    rng = random.Random(seed)
    shared = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(16)]
    texts = [" ".join([rng.choice("klmnop") for _ in range(rng.randrange(40))] + shared + ["z"] * rng.randrange(20)) for _ in range(2)]
    h, at = word_hashes(texts)
    kept, g = winnow(h, at, 8, 9)
    a, b = (set(g[(kept >= at[i]) & (kept < at[i + 1])].tolist()) for i in range(2))
    assert a & b


def never_broadcast(monkeypatch, *modules):
    """As if every table were too large to be broadcast."""
    from kodex import session

    monkeypatch.setattr(session, "PLAIN_BYTES", -1)
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    for m in modules:
        if hasattr(m, "lookup"):
            monkeypatch.setattr(m, "lookup", lambda *a, **k: session.lookup(*a, **k, rows=-1))
        if hasattr(m, "sized_broadcast"):
            monkeypatch.setattr(m, "sized_broadcast", lambda df: df)


LEAK = "doc_id long, text string, n_chars string, h string"


@pytest.mark.parametrize("seed", range(3))
def test_leaks_are_brute_force(spark, seed, monkeypatch):
    if seed == 1:
        never_broadcast(monkeypatch, leakage)
    rng = random.Random(seed)
    vocab = ["soud", "Žalobce", "právo", "§", "12", "věc", "él", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(6)] + [(90, None), (91, ""), (92, "krátká"), (93, " ".join(["x"] * 30))]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))
        if i % 2:
            words = (rng.choice(items[:6])[1]).split()
            a, n = rng.randrange(10), rng.choice([14, 15, 16, 17, 18, 25])
            text += "\r\n– " + ", ".join(w.upper() for w in words[a : a + n]) + "; " + text
        docs.append((i, text, "n", "h"))
    docs += [(100, None, "n", "h"), (101, "", "n", "h"), (None, items[0][1], "n", "h"), (102, " ".join(["x"] * 4000), "n", "h"), (103, items[1][1], "n", "h"), (103, items[1][1], "n", "h")]
    runs = lambda t: {tuple(w[i : i + 16]) for w in [plain_words(t or "")] for i in range(len(w) - 15)}
    want = {(d, i) for d, t, *_ in docs for i, x in items if d is not None and runs(t) & runs(x)}
    df, it = spark.createDataFrame(docs, LEAK), spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, pos string")
    spans = [tuple(r) for r in leakage.leaks(df, it).collect()]
    got = {s[:2] for s in spans}
    text_of, item_of = {d: plain_words(t or "") for d, t, *_ in docs}, {i: plain_words(t or "") for i, t in items}
    longest = set()
    for d, i in want:
        a, b = text_of[d], item_of[i]
        for x in range(len(a)):
            for y in range(len(b)):
                if a[x] == b[y] and not (x and y and a[x - 1] == b[y - 1]):
                    n = next((k for k in range(min(len(a) - x, len(b) - y)) if a[x + k] != b[y + k]), min(len(a) - x, len(b) - y))
                    longest |= {(d, i, n, x, y)} if n >= 16 else set()
    assert set(spans) == longest
    assert got == want and any(d < 60 for d, _ in got) and (102, 93) in got
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


def check_pieces(text, limit, overlap):
    got = splitting.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for a, b, n in got:
        assert a < b and n == len(text[a:b].encode()) <= limit
    for (_, b, _), (a, _, _) in zip(got, got[1:]):
        assert overlap <= len(text[a:b].encode()) <= overlap + 3
    return got


@pytest.mark.parametrize("text", ["a" * 999, "ř" * 500, "😀" * 300, "slovo " * 200, "Věta jedna. " * 90, "a\r\n" * 400, "é" * 300, " " * 700, "x" * 99 + "\n\n" + "y" * 350])
def test_pieces_cover_and_overlap(text):
    check_pieces(text, 100, 16)


def test_pieces_end_at_the_best_boundary():
    text = "Prvni veta je tu. " * 3 + "\n\n" + "druhy odstavec, dlouhy. " * 6
    assert text[: splitting.cuts(text, 80, 8)[0][1]].endswith("\n\n")
    assert splitting.cuts("bez mezer" * 3, 100, 8) == [(0, 27, 27)] and splitting.cuts("", 100, 8) == []
    with pytest.raises(ValueError):
        splitting.cuts("x", 100, 50)


def test_pieces_in_tokens_of_a_vocabulary():
    text = "Soud vyšel z rozhodnutí č. j. 1 As 2/2010. " * 60
    got = splitting.cuts(text, 200, 20, "byte_bpe_50k.tiktoken")
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(n <= 200 for *_, n in got) and all(a2 < b for (_, b, _), (a2, _, _) in zip(got, got[1:]))


def test_pieces_operator(spark):
    df = spark.createDataFrame([(1, "x " * 2000, "n"), (2, "kratky", "n"), (3, "", "n"), (4, None, "n"), (None, "y", "n"), (5, "ž" * 3000, "n")], "doc_id long, text string, piece string")
    out = [tuple(r) for r in splitting.pieces(df, "doc_id", "text").collect()]
    assert {r[0] for r in out} == {1, 2, 5} and max(r[4] for r in out) <= 2048
    assert {r.doc_id for r in splitting.pieces(df, "doc_id", "text", oversized_only=True, with_text=False).collect()} == {1, 5}
    assert splitting.pieces(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_flow_costs_least(seed):
    rng = random.Random(seed)
    supply, need = [rng.randrange(1, 4) for _ in range(2)], [rng.randrange(1, 5) for _ in range(2)]
    g = Flow()
    for i, s in enumerate(supply):
        for k in (1, 2):
            g.arc("from", i, s, k)
        for j in range(2):
            g.arc(i, ("t", j), 9)
    for j, n in enumerate(need):
        g.arc(("t", j), "to", n)
    sent = g.run("from", "to")
    assert sent == min(sum(need), 2 * sum(supply))
    # every first use comes before any second one
    first = sum(supply)
    cost = sum(g.cost[e] * g.left[e + 1] for e in range(0, len(g.to), 2))
    assert cost == min(sent, first) + 2 * max(0, sent - first)


def mixed(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, h string, n_tokens string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen = mixing.mix(d, t, tokenizer="bytes", **kw)
    return chosen.collect(), {r.source: r for r in mixing.shares(chosen, t).collect()}


def test_mix_meets_shares_and_limits(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["a"] * 10 + ["b", "c", "other", None]), "x" * rng.randrange(1, 60) + str(i), "-", "-") for i in range(3000)]
    docs += [(5000 + i, s, t, "-", "-") for i, (_, s, t, *_) in enumerate(docs[:100]) for s in ["b"]]
    docs += [(9000, "a", "", "-", "-"), (9001, "a", None, "-", "-"), (None, "a", "yy", "-", "-")]
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]
    chosen, shares = mixed(spark, docs, targets)
    by_id = {d[0]: d for d in docs}
    limit = {s: n for s, _, n in targets}
    for r in chosen:
        assert r.source == by_id[r.doc_id][1] and r.n_tokens == len(by_id[r.doc_id][2]) and 1 <= r.repeats <= limit[r.source]
    used = defaultdict(int)
    for r in chosen:
        used[by_id[r.doc_id][2]] += r.repeats
    assert max(used.values()) <= 3
    for s, share in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(shares[s].actual_share - share) < 0.01, shares
    assert shares["none"].actual_share == 0 and shares["none"].documents == 0
    again, _ = mixed(spark, docs, targets)
    assert sorted(again) == sorted(chosen)
    other, _ = mixed(spark, docs, targets, seed=7)
    assert sorted(other) != sorted(chosen)


def test_mix_total_and_odd_cases(spark):
    docs = [(i, "ab"[i % 2], f"{i:04d}", "-", "-") for i in range(1000)]
    chosen, shares = mixed(spark, docs, [("a", 0.25, 1), ("b", 0.75, 1)], total=1000)
    assert abs(sum(r.n_tokens * r.repeats for r in chosen) - 1000) <= 8 and abs(shares["a"].actual_share - 0.25) < 0.01
    chosen, shares = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.5, 1)], total=10**6)
    assert shares["a"].max_used == 2 and shares["b"].max_used == 1 and shares["a"].documents == 500
    for d, t in (([], [("a", 1.0, 1)]), (docs, []), (docs, [("z", 1.0, 1)]), (docs, [("a", 1.0, 0)])):
        assert mixed(spark, d, t)[0] == []


def test_every_pattern_enters_the_flow(spark):
    """Shares are those of the flow over all patterns; a bound on their number only ever raises."""
    sizes = [("a\x1fb", 50), ("a", 40), ("b", 30), ("a\x1fb\x1fc", 20), ("c", 10)]
    goal = {"a": (0.4, 1), "b": (0.4, 1), "c": (0.2, 1)}
    lines, parts = mixing.plan(sizes, goal)
    assert dict(lines)["a\x1fb\x1fc"] == "a\x1fb\x1fc"
    got = defaultdict(int)
    for _, source, _, _, n in parts:
        got[source] += n
    assert sum(got.values()) == 150 and got == {"a": 60, "b": 60, "c": 30}
    rng = random.Random(2)
    names = [f"s{i}" for i in range(12)]
    texts = [(rng.sample(names, rng.randrange(1, 5)), f"text {i} " * rng.randrange(1, 9)) for i in range(1500)]
    docs = [(100 * i + k, s, t, "-", "-") for i, (held, t) in enumerate(texts) for k, s in enumerate(held)]
    targets = [(s, 1 / 12, 2) for s in names]
    assert len({tuple(sorted(held)) for held, _ in texts}) > 300
    chosen, shares = mixed(spark, docs, targets, total=60_000)
    bounded, same = mixed(spark, docs, targets, total=60_000, max_patterns=5000)
    assert sorted(chosen) == sorted(bounded) and shares == same
    assert all(abs(r.actual_share - 1 / 12) < 0.01 for r in shares.values())
    with pytest.raises(ValueError, match="patterns"):
        mixed(spark, docs, targets, max_patterns=10)


BODY = "para_id long, ecli string, idx int, body string, court_code string, chunk long"


def plain_recurring(rows, court, least, share):
    form = lambda line: re.sub("^ | $", "", re.sub("[ \t]+", " ", re.sub(r"\d+", "0", line.lower())))
    held, total = defaultdict(set), defaultdict(set)
    lines = [(p, i + 1, court.get(e), e, form(x)) for p, e, b in rows if b is not None for i, x in enumerate(b.split("\n"))]
    for p, e, b in rows:
        if court.get(e):
            total[court[e]].add(e)
    for _, _, c, e, f in lines:
        if c and f:
            held[c, f].add(e)
    return sorted({(p, i) for p, i, c, e, f in lines if c and f and len(held[c, f]) >= least and len(held[c, f]) >= share * len(total[c])})


@pytest.mark.parametrize("seed", range(4))
def test_recurring_lines_are_brute_force(spark, seed, monkeypatch):
    if seed == 1:
        never_broadcast(monkeypatch, boilerplate)
    rng = random.Random(seed)
    notes = ["takto:", "Poučení: Proti tomuto rozsudku nejsou přípustné opravné prostředky, jak stanoví zákon č. 150/2002 Sb.", "Strana 1 z 2", "x", "Sdílejte tento dokument\tdne 1. 2. 2020 "]
    vary = lambda s: re.sub(r"\d+", lambda m: str(rng.randrange(10**6)), rng.choice([s, s.upper(), "  " + s, s.replace(" ", " \t")]))
    words = "soud žalobce právo věc rozhodnutí zákon".split()
    rows = []
    for p in range(400):
        e = rng.choice(["hot"] * 10 + [f"e{i}" for i in range(60)])
        body = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(3))]
        body += [vary(rng.choice(notes)) for _ in range(rng.randrange(3) if e != "hot" else 1)] + rng.choice([[], [""], [" \t"]])
        rng.shuffle(body)
        rows.append((p, e, "\n".join(body)))
    rows += [(1000, None, "takto:"), (1001, "e1", None), (1002, "e2", ""), (1003, "lost", "takto:"), (1004, "e3", "řádek " * 20000 + "\ntakto:")]
    court = {e: ("US" if hash_ % 3 else None) for hash_, e in enumerate(["hot", *[f"e{i}" for i in range(60)]], start=1)}
    df = spark.createDataFrame([(p, e, 1, b, "zz", 5) for p, e, b in rows], BODY)
    dec = spark.createDataFrame([(e, c, "b") for e, c in court.items()] * 2, "ecli string, court_code string, body string")
    for least, share in ((4, 0.05), (10, 0.3)):
        got = sorted((r.para_id, r.line_no) for r in boilerplate.recurring_lines(df, dec, least, share, mean=16).collect())
        assert got == plain_recurring([r for r in rows if r[1]], court, least, share)
        assert got or least == 10
    found = boilerplate.recurring_lines(df, dec, 4, 0.05, mean=16)
    gone = {(r.para_id, r.line_no) for r in found.collect()}
    want = {p: None if b is None else "\n".join(x for i, x in enumerate(b.split("\n")) if (p, i + 1) not in gone) for p, _, b in rows}
    assert {r.para_id: r.body for r in boilerplate.without_lines(found, df).collect()} == want
    assert sum(r.occurrences for r in boilerplate.line_texts(found, df).collect()) == len(gone)
    assert boilerplate.recurring_chunks(df, dec, 4, 0.05, mean=16).count() > 0
    flat = {p: " ".join(re.sub(r"\d+", "0", b.lower()).split()) for p, e, b in rows if b is not None and court.get(e)}
    cut = {r.para_id: r for r in boilerplate.without_chunks(df, dec, 4, 0.05, mean=16).collect()}
    assert cut.keys() == flat.keys() and any(r.cut for r in cut.values())
    assert all(r.kept == flat[p] for p, r in cut.items() if not r.cut) and all(len(r.kept) < len(flat[p]) for p, r in cut.items() if r.cut)
    assert boilerplate.recurring_lines(df.limit(0), dec).count() == 0 and boilerplate.recurring_lines(df, dec.limit(0)).count() == 0


def test_rewrapped_notices_have_the_same_chunks(spark):
    """A notice that every decision breaks into lines in another way is cut from each of them, the rest stays."""
    rng = random.Random(5)
    notice = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(120))
    wrap = lambda: "".join(rng.choice([" ", "\n", "\r\n", "  "]) if c == " " else c for c in notice)
    own = [" ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(60)) for _ in range(30)]
    rows = spark.createDataFrame([(i, f"e{i}", 1, f"{own[i]}\n{wrap()}\n{own[i][::-1]}", "z", 1) for i in range(30)], BODY)
    dec = spark.createDataFrame([(f"e{i}", "US") for i in range(30)], "ecli string, court_code string")
    assert boilerplate.recurring_lines(rows, dec).filter("documents >= 30").count() == 0
    cut = {r.para_id: r.kept for r in boilerplate.without_chunks(rows, dec, mean=16).collect()}
    for i, kept in cut.items():
        left = sum(w in kept.split() for w in notice.split())
        assert left < 25 and kept.startswith(own[i][:300]) and kept.endswith(own[i][::-1][-300:]), (i, left)


def test_chunks_depend_on_content_alone():
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefghij ") for _ in range(400))
    texts = [f"{'z' * n}\n{line}\nkonec" for n in (0, 1, 7, 300)] + [line]
    text, row, place, h = boilerplate.chunk(texts, 12, 32)
    per = [h[(text == i) & (row == (1 if i < 4 else 0))].tolist() for i in range(5)]
    assert all(x == per[0] for x in per) and len(per[0]) > 4
    assert [len(x) for x in boilerplate.chunk(["", "\n\n"])] == [0] * 4
