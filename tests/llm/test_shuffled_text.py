"""Training-text queries give the same rows when nothing is small enough to be broadcast."""

import pytest

from kodex import session
from kodex.llm import queries


@pytest.mark.parametrize("name", ["p1_found", "p1_restored", "p2_found", "p3_found", "p3_lines", "p3_cut", "p7_spans", "p8_mix"])
def test_same_rows_without_broadcasts(spark, data, monkeypatch, name):
    rows = lambda: sorted(map(str, queries.QUERIES[name](spark, data).collect()))
    want = rows()
    monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(session, "PLAIN_BYTES", -1)
    assert rows() == want and want
