"""Deep, wide and nested inputs beyond any fixed bound; distances by hand; exports."""


def test_many_parents(spark):
    from lorewell.operators.exports import under_all_parents

    parents = spark.createDataFrame([(f"p{i}",) for i in range(1500)], "parent string")
    up = spark.createDataFrame([("all", f"p{i}") for i in range(1500)] + [("most", f"p{i}") for i in range(1000)] + [("none", "q")], "node string, ancestor string")
    names = spark.createDataFrame([("all",), ("most",), ("none",), ("new",)], "concept string")
    assert {r.concept for r in under_all_parents(names, parents, up).collect()} == {"all", "new"}
    assert under_all_parents(names, parents.limit(0), up).count() == 4


def test_long_proof(spark):
    from lorewell.operators.graph import justify

    direct = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(24)] + [("n03", "n01")], "arg1 string, arg2 string")
    assert justify(direct, "n00", "n22").first().path == [f"n{i:02d}" for i in range(23)]
    assert justify(direct, "n22", "n00").count() == 0


def test_deep_preprocessing(spark):
    from lorewell.operators.resolution import preprocess

    # Innermost brackets go one level at a time.
    text = "some_thing" + " (a" * 7 + ")" * 7
    got = preprocess(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert max(r.level for r in got) == 8 and {r.text for r in got if r.level == 8} == {"some thing"}


def test_distances(spark):
    from lorewell.operators import graph

    genls = spark.createDataFrame([("dog", "pet"), ("pet", "thing"), ("cat", "thing"), ("breed", "thing")], "arg1 string, arg2 string")
    isa = spark.createDataFrame([("dog", "breed"), ("rex", "dog"), ("dog", "thing")], "arg1 string, arg2 string")
    up = graph.closure(genls)
    pairs = spark.createDataFrame([("dog", "cat"), ("dog", "dog"), ("dog", "thing"), ("dog", "breed"), ("rex", "dog"), ("cat", "rex"), ("cat", "pet")], "a string, b string")
    d = {(r.a, r.b): r.distance for r in graph.semantic_distance(pairs, up, graph.isa_closure(isa, up), 10).collect()}
    # Above dog: dog, pet, thing by genls; breed, thing by isa: five, four of them different.
    assert d["dog", "cat"] == (5 - 1) / (10 - 2) and d["dog", "dog"] == 0 and d["cat", "rex"] == -1
    p = {(r.a, r.b): r.distance for r in graph.proof_distance(pairs, up, isa).collect()}
    assert p == {("dog", "cat"): -1, ("dog", "dog"): 0, ("dog", "thing"): 1, ("dog", "breed"): 1, ("rex", "dog"): -1, ("cat", "rex"): -1, ("cat", "pet"): -1}


def test_nested_markup():
    from lorewell.functions.markup import clean_text, drop_useless_text

    assert clean_text("a {{x {{y {{z}} }} }}b [[File:p.png|thumb|a [[link|label]] in it]]c [[one|two [[three]] four]]") == "a b c two three four"
    assert clean_text("open {{ never closed [[x]] and <b>bold</b> text<br/>next , line ( )") == "open {{ never closed x and text\nnext, line"
    assert clean_text(":indented\n''all italics''\n'''Bold''' &mdash; &amp; [http://a.b label] [http://a.b]__TOC__") == "Bold - &amp; label"
    assert drop_useless_text("{{t}} [[a|b]] <ref name=x>no</ref><!-- c\nd -->  z") == "{{t}} [[a|b]] z"


def test_plain_text(spark):
    from pyspark.sql import functions as F

    from lorewell.operators.catalogue import plain_text

    text = "Intro is here.\n\n== History ==\nOld things.\n=== Deeper ===\nMore of it.\n\n\n\n== See also ==\n* x\n\n== Notes ==\nA list:\n\n*\nEnd  of it."
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(plain_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["Intro is here.\n\nMore of it.\n\nEnd of it.", None, ""]


def test_merges(spark):
    from lorewell.operators.catalogue import merge_information, merge_standing

    kind = "article_id int, mined int, infobox_type string, assertions array<string>"
    one = spark.createDataFrame([(1, 7, "city", ["a"]), (2, 1, None, [])], kind)
    two = spark.createDataFrame([(1, 5, None, ["a", "b"]), (3, 2, "x", ["c"])], kind)
    got = {r.article_id: (r.mined, r.infobox_type, sorted(r.assertions)) for r in merge_information(one, two).collect()}
    assert got == {1: (5, "city", ["a", "a", "b"]), 2: (1, None, []), 3: (2, "x", ["c"])}
    s = spark.createDataFrame([("k", 1, 2)], "key string, n_individual int, n_collection int")
    assert tuple(merge_standing(s, s, "key").first()) == ("k", 2, 4)
