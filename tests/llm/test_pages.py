"""WARC archives and main text of pages."""

import hashlib

import pytest


def test_warc_round_trip(spark, tmp_path):
    from lorewell.llm.warc import read_archives, resolve_revisits, write_archives

    big, other = "<p>é" + "x" * 2000, "<p>" + "y" * 1500
    data = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", other), (None, "n", other), (8, "u", "é" * 499), (9, "u", "é" * 499), (10, "u", "é" * 500), (11, "u", "é" * 500)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as digest", "3 as k")
    files = write_archives(df, f"file://{tmp_path}/w", file_bytes=900)
    files.write.parquet(f"{tmp_path}/files")
    records = read_archives(spark.read.parquet(f"{tmp_path}/files"))
    got = {r.key: r for r in resolve_revisits(records).collect()}
    want = {1: 3, 2: 3, None: 7, 10: 11}
    for i, url, html in data:
        r, raw = got[i], (html or "").encode()
        assert (r.payload_bytes, r.digest, r.refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), want.get(i))
        assert r.record_type == ("revisit" if i in want else "response")
        assert r.payload is None if i in want else r.payload == raw
    assert got[2].url == "http://a/2%0D%0AX: y" and got[3].url is None
    none = write_archives(df.filter("false"), f"file://{tmp_path}/e")
    assert none.count() == 0


def test_truncated_archive_is_an_error(spark, tmp_path):
    from lorewell.llm.warc import members, _gzip
    import io

    data = _gzip(b"WARC/1.1\r\n\r\n" * 9)
    assert len(list(members(io.BytesIO(data * 3), 7))) == 3
    with pytest.raises(OSError):
        list(members(io.BytesIO(data[:-9])))


PAGES = {
    '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">a</a></ul></nav><div class="ad">buy</div><article><h1>H &amp; I</h1><p><b>one.<br><p>two\n  three&amp;&amp;</p></article><footer>&copy;</footer>': "H & I\n\none.\n\ntwo three&&",
    '<div class="sidebar">' + "side text " * 30 + "</div><div><h2>T</h2><p>" + "word " * 40 + "</p><p>short</p></div><div id='comments'><p>" + "c " * 200 + "</p></div>": "T\n\n" + ("word " * 40).strip() + "\n\nshort",
    '<article class="post"><header><h1>Hi</h1></header><p title="a>b">x &lt;b&gt; y<script>var a="</p>";</script></p><div class="ad">buy</div><ul><li>one</li><li>two</li></ul><aside>no</aside><section class="comments"><article class="comment">bad</article></section><form>f</form></article>': "Hi\n\nx <b> y\n\none\n\ntwo",
    "<article><p>cut off in the mid": "cut off in the mid",
    "": "",
    "<script>never closed <p>x</p>": "",
    "plain words": "plain words",
}


def test_main_text():
    from lorewell.llm.html_text import main_text

    for page, text in PAGES.items():
        assert main_text(page) == text
    assert main_text(None) == ""


def test_line_block_distribution():
    from lorewell.llm.html_text import between

    assert between([5, 0, 0, 100, 90, 3, 80, 0, 0, 0, 0, 6, 0]) == [(3, 7)]
    assert between([]) == [] and between([0, 0]) == []


def test_extract_text(spark):
    from lorewell.llm.html_text import extract_text

    data = [(i, "u", p) for i, p in enumerate(PAGES)] + [(99, None, None), (99, None, None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as row", "3 as pad")
    out = extract_text(df)
    assert out.columns == ["page_id", "url", "text", "row", "pad", "text_", "n_chars"]
    for r in out.collect():
        want = list(PAGES.values())[r.page_id] if r.page_id < 99 else ""
        assert (r.text_, r.n_chars) == (want, len(want))
    assert extract_text(df.filter("false")).count() == 0
