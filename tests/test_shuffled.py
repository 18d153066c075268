"""Queries whose lookups are broadcast on small data give the same rows when every one of them is a salted shuffle."""

import pytest

from kodex import session
from kodex.plans import graph, text, training


@pytest.mark.parametrize("name", ["p4_found", "p5_found", "j7_relied_on", "w9_verdicts", "w3_resolved_provisions", "c11_routes"])
def test_same_rows_without_broadcasts(spark, data, monkeypatch, name):
    query = {**graph.QUERIES, **text.QUERIES, **training.QUERIES}[name]
    rows = lambda: sorted(map(str, query(spark, data).collect()))
    want = rows()
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(session, "PLAIN_BYTES", -1)
    assert rows() == want and want
