"""Queries over bitmaps put their rows together once, however many jobs read them."""

import pytest

from linklens.checks import catalog, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "view"), [("a13_bitmap_totals", "fx_external_domains"), ("a15_bitmap_top_roots", "fx_external_domains"), ("a17_bitmap_metrics", "fx_tickets")])
def test_one_read_of_the_view(spark, monkeypatch, name, view):
    made, whole = [], views.view
    monkeypatch.setattr(views, "view", lambda s, d, n: (made.append(n), whole(s, d, n))[1])
    out = catalog.QUERIES[name](spark, SF)
    assert made.count(view) == 1
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "lineitem" not in plan and "l_discount" not in plan
    assert out.count() > 0
