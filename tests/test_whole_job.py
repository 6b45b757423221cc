"""Queries and operators on more than their first slice of the input."""

import duckdb

from lorewell.operators import consistency
from lorewell.plans import catalog, consistency_queries

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem".split()


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def duck(sql):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c.sql(sql).fetchall()


def test_solver_has_every_subject(spark):
    got = {r.module: r.weight for r in catalog.queries()["consistency_solver"](spark, DIR).collect()}
    want = dict(duck(catalog.oracle_sql()["consistency_solver"]))
    assert max(got) > 300 and set(got) == set(want) == {s for (s,) in duck("SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")}
    assert all(abs(got[m] - want[m]) < 1e-5 for m in want)


def test_accept_assertions_against_brute_force(spark):
    got = rows(catalog.queries()["accept_assertions"](spark, DIR), "subject", "assertion")
    region = dict(duck("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"))
    votes = {}
    for s, t, w in duck(f"WITH {consistency_queries._NORM} SELECT subject, target, weight FROM norm"):
        votes.setdefault(s, []).append((-w, t))
    want = []
    for s, found in votes.items():
        chosen = []
        for _, t in sorted(found):
            if all(region[t] == region[c] for c in chosen):
                chosen.append(t)
        want += [(s, t) for t in chosen]
    assert got == sorted(want, key=repr)


def test_accept_has_no_last_round(spark):
    c = spark.createDataFrame([("s", f"a{i:02}", 1.0 - i / 100) for i in range(20)] + [("t", None, 1.0)], "subject string, assertion string, weight double")
    got = rows(consistency.accept(c, spark.createDataFrame([("a00", "a01")], "a string, b string")), "assertion")
    assert [a for (a,) in got if a] == ["a00", *(f"a{i:02}" for i in range(2, 20))] and len(got) == 20
