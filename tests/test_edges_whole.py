"""Edges by their arguments, for every customer."""

from lorewell.operators import catalogue
from lorewell.plans import catalog

from .test_whole_job import DIR, duck, rows


def test_edge_by_args_has_every_customer(spark):
    got = rows(catalog.queries()["edge_by_args"](spark, DIR), "pattern", "edge")
    assert got == sorted(duck(f"SELECT pattern, edge FROM ({catalog.oracle_sql()['edge_by_args']})"), key=repr)
    assert len(got) == duck("SELECT count(*) FROM customer")[0][0]


def test_edge_by_args_makes_no_pairs(spark):
    edges = spark.createDataFrame([("isa", f"x{i}", "y", f"e{i}") for i in range(50)] + [("one", "a", "b", "only")], "pred string, arg1 string, arg2 string, edge string")
    want = [(i, "isa", f"x{i}", None) for i in range(50)] + [(60, "isa", None, None), (61, "isa", None, "y"), (62, "one", None, None), (63, "one", None, "b"), (64, "isa", "x3", "y"), (65, "isa", "x3", "z")]
    out = catalogue.edge_by_args(spark.createDataFrame(want, "pattern int, pred string, arg1 string, arg2 string"), edges)
    got = {r.pattern: r.edge for r in out.collect()}
    assert got == {i: f"e{i}" for i in range(50)} | {60: None, 61: None, 62: "only", 63: "only", 64: "e3", 65: None}
