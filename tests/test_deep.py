"""Deep chains and modules of much evidence."""

from lorewell.operators import catalogue, consistency, graph, mapping

from .test_whole_job import rows


def test_redirects_of_any_length(spark):
    red = spark.createDataFrame([(i, i + 1) for i in range(21)] + [(50, 51), (51, 52), (52, 50), (53, 50)], "src int, dst int")
    found = spark.createDataFrame([("s", 0, 1.0), ("s", 9, 2.0), ("s", 53, 4.0), ("s", 51, 4.0), ("s", 99, 8.0)], "source string, target int, weight double")
    assert rows(mapping.follow_redirects(found, red)) == [("s", 21, 3.0), ("s", 99, 8.0)]


def test_sub_categories_of_any_depth(spark):
    direct = spark.createDataFrame([(f"a{i + 1}", f"a{i}") for i in range(18)] + [("a0", "a18")], "arg1 string, arg2 string")
    assert catalogue.relevant_closure(spark.createDataFrame([("a0", "a")], "root string, text string"), direct).count() == 18


def test_closure_has_no_last_step(spark):
    direct = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(67)], "arg1 string, arg2 string")
    assert graph.closure(direct).agg({"depth": "max"}).first()[0] == 67


def test_solver_searches_all_columns(spark):
    cells = [(1, 0, 0, "h", 1.0)] + [(1, i, 0, f"t{i:02}", 0.9) for i in range(1, 71)] + [(2, i, 0, f"{'ab'[i % 2]}{i:02}", 1.0 - 0.001 * i) for i in range(100)]
    dis = [("h", f"t{i:02}") for i in range(1, 71)] + [(f"a{i:02}", f"b{j:02}") for i in range(0, 100, 2) for j in range(1, 100, 2)]
    out = consistency.solve(spark.createDataFrame(cells, "module int, x int, y int, assertion string, weight double"), spark.createDataFrame(dis, "a string, b string"))
    got = {r.module: r for r in out.collect()}
    assert abs(got[1].weight - 63.0 / 64.0) < 1e-9 and sorted(got[1].assertions) == [f"t{i:02}" for i in range(1, 71)]
    a = sum(1.0 - 0.001 * i for i in range(0, 100, 2))
    assert abs(got[2].weight - a / sum(1.0 - 0.001 * i for i in range(100))) < 1e-9 and len(got[2].assertions) == 50
