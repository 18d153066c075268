"""Every query with a SQL twin gives its rows, on the smallest data; the others run and keep their promises."""

import pytest

from kodex.plans import files, graph, more, text, training

MODULES = (graph, text, more, training, files)
CORE = {n: (m.QUERIES[n], m.ORACLE[n]) for m in MODULES for n in m.ORACLE}
REST = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLE]


@pytest.mark.parametrize("name", sorted(CORE))
def test_same_rows_as_sql(compare, name):
    got, want = compare(*CORE[name])
    assert got == want


@pytest.mark.parametrize("module,name", REST, ids=[n for _, n in REST])
def test_runs(spark, data, module, name):
    rows = module.QUERIES[name](spark, data).collect()
    # tested against brute force elsewhere; on the test data each has rows, and as a set none twice
    assert rows and len(set(map(str, rows))) == len(rows)


def test_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))
