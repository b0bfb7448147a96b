"""Destinations of envious methods on small files."""

from __future__ import annotations

from lintel.functions import python_scopes
from lintel.operators import moves

SHOP = '''
class Order:
    pass
class Basket:
    def __init__(self, order): order.a + order.b
    def total(self, order): return order.price + order.tax
    def other(self, x: "Order"): return x.a + x.b + self.y
    def own(self, basket): return basket.a + basket.b
    def named(self, orders, k): return orders.a + orders.b + k.c
    def tied(self, order, k): return order.a + order.b + k.a + k.b
    def less(self, order): return order.a + order.b + self.a + self.b
    def again(self, order):
        order = order.next
        return order.a + order.b
    def inner(self, order): return [f for f in map(lambda v: v, [order.a, order.b])]
    def called(self, item): return item.a + item.b
    def lost(self, order): return order.a + order.b
    def mentioned(self, order): return order.a + order.b
    def both(self, order: "Line"): return order.a + order.b
    def starred(self, order): return order.a + order.b
class Line: pass
b = Basket(None)
line = Line()
b.called(line)
b.total(Order())
Basket(1).total(order=Order())
unknown.lost(Order())
hook = b.mentioned
b.starred(*[1])
'''


def test_reasons_and_winners(spark):
    files = spark.createDataFrame([("r", "a.py", SHOP), ("s", "a.py", "class A:\n  def f(self, order): return order.a + order.b\n"), ("r", "b.py", "def broken(:"), ("r", "c.py", None)], "repository string, path string, text string")
    facts = python_scopes.scopes(files).cache()
    found, losers = moves.destinations(facts)
    got = {(r["repository"], r["method"]): (r["destination"], r["reason"]) for r in found.collect()}
    why = {m: got["r", m][1] for m in ("__init__", "own", "tied", "less", "again", "inner", "lost", "mentioned", "both", "starred")}
    assert why == {
        "__init__": "SOURCE_METHOD_NOT_MOVABLE", "own": "NO_VALID_DESTINATION_CLASS", "tied": "NO_FEATURE_ENVY_EVIDENCE", "less": "NO_FEATURE_ENVY_EVIDENCE", "again": "DESTINATION_PARAMETER_REASSIGNED", "inner": "NESTED_SCOPE_UNSUPPORTED",
        "lost": "CALL_SITE_REWRITE_FAILED", "mentioned": "CALL_SITE_REWRITE_FAILED", "both": "AMBIGUOUS_DESTINATION_CLASS", "starred": "CALL_SITE_REWRITE_FAILED",
    }
    assert {m: got["r", m] for m in ("total", "other", "named", "called")} == {"total": ("Order", None), "other": ("Order", None), "named": ("Order", None), "called": ("Line", None)}
    assert got["s", "f"] == (None, "NO_VALID_DESTINATION_CLASS")
    lost = {(r["method"], r["class"]): (r["reason"], r["score"]) for r in losers.collect()}
    assert lost["own", "Basket"] == ("SOURCE_AND_DESTINATION_CLASS_MATCH", 3) and lost["both", "Line"] == ("AMBIGUOUS_DESTINATION_CLASS", 6) and lost["both", "Order"][1] == 3
    assert ("lost", "Order") in lost and not any(m == "total" for m, _ in lost)
    empty, _ = moves.destinations(python_scopes.scopes(files.filter("path = 'c.py'")))
    assert empty.count() == 0
