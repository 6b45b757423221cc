"""Disjoint pairs that every task holds, and those that travel with each module; grids made of one scan."""

import pyarrow as pa

from lorewell.operators import conjoint, consistency
from lorewell.plans import catalog

DIR = "/root/testdata/sf0.001"


def test_searches_read_their_tables_once(spark):
    for name in ("consistency_solver", "conjoint_cases"):
        plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("Relation [l_orderkey" in line for line in plan.splitlines()) == 1
        # No module carries its pairs, as all are few.
        assert "pairs" not in plan


def test_pairs_beyond_the_shared_ones_travel(spark, monkeypatch):
    both = []
    for most in (consistency.SHARED, 0):
        monkeypatch.setattr(consistency, "SHARED", most)
        both.append([sorted(catalog.queries()[n](spark, DIR).collect()) for n in ("consistency_solver", "conjoint_cases")])
    assert both[0] == both[1] and all(map(len, both[0]))


def test_rules_and_truths_on_both_ways(spark, monkeypatch):
    cells = spark.createDataFrame([(1, 0, 0, None, "isaGenls", "Dog", 1.0, 1), (1, 1, 0, None, "owner", "Rex", 0.5, 1), (2, 0, 0, None, "isa", "Cat", 1.0, 1)], "module int, x int, y int, parent int, relation string, arg string, weight double, position int")
    rules = spark.createDataFrame([("owner", 1, "isa", "Person")], "relation string, position int, kind string, term string")
    told = spark.createDataFrame([(2, "isa", "Stone")], "module int, kind string, term string")
    apart = spark.createDataFrame([("Person", "Dog"), ("Stone", "Cat"), ("Collection", "Person")], "a string, b string")
    one = sorted(conjoint.cases(cells, apart, rules, told, most=None).collect())
    monkeypatch.setattr(consistency, "SHARED", 0)
    assert one and one == sorted(conjoint.cases(cells, apart, rules, told, most=None).collect())


def test_pairs_in_either_order():
    cells = [(0, 0, "cat", 1.0), (1, 0, "dog", 0.6)]
    assert consistency.largest_consistent(cells, {("dog", "cat")}) == consistency.largest_consistent(cells, {("cat", "dog")}) == (1.0 / 1.6, ["cat"])


def test_few_modules_at_a_time():
    batch = pa.RecordBatch.from_pydict({"module": list(range(1000))})
    got = list(consistency.each_module([batch]))
    assert max(map(len, got)) <= consistency.AT_ONCE and [m["module"] for some in got for m in some] == list(range(1000))
