"""Titles that look like camel case, or hold brackets, bars, references and line ends."""

import shutil

import duckdb
import pytest

from lorewell.plans import catalog

TITLES = ["Foo Bar", "Foo bar", "foo bar", "AKIA42AMR is Here", "AKIA42 AMR is here", "iPhone", "iPhone", "I Phone", "a_b", "a b", "", "", "a | b", "a | b", "[x] y", "a]]b", "a\nb", "a&#124;b", "a&#38;b", "a &amp; b", "A|", "Über Öl", "über öl", "a  b", " a ", "ßa B", "ŉa B", "ﬁa", "ᾳb", "ΑΣ ΑΣ", "Ασ ασ", "Ας ας", "İx İy", "İx iy", "ǆa"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    # Each title once among all last digits, so that each is a list's next page, too.
    rows = [(10 * i + k, f"<html><title>{t}</title><a href=\"/{t[:3]}\">l</a></html>") for i, t in enumerate(TITLES) for k in (3, 4)] + [(997, None), (998, "none")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    yield str(d)
    shutil.rmtree(d, ignore_errors=True)


@pytest.mark.parametrize("name", ["title_match", "configured_suite", "list_children"])
def test_odd_titles(spark, odd, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{odd}/pages.parquet/*.parquet'")
    got = catalog.queries()[name](spark, odd)
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(c.sql(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=repr)
