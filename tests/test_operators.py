"""Operators on small tables."""

from pyspark.sql import functions as F

from lorewell.functions import standing, weights, wikitext
from lorewell.operators import consistency, evaluate, graph, lookups, mapping, mining
from lorewell.sources import stores
from lorewell.streaming import incremental


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_weighted_sets(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 2.0), ("a", "y", 1.0), ("a", "z", 0.01), ("b", "x", 3.0)], "k string, e string, weight double")
    total = weights.combine_sum(df, ["k", "e"])
    assert rows(weights.normalise_max(total, ["k"])) == [("a", "x", 1.0), ("a", "y", 0.25), ("b", "x", 1.0)]
    assert rows(weights.normalise_sum(weights.combine_max(df, ["k", "e"]), ["k"], cutoff=0.3), "k", "e") == [("a", "x"), ("a", "y"), ("b", "x")]
    tied = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0)], "k string, e string, weight double")
    assert weights.most_likely(tied, ["k"]).count() == 2 and weights.first(tied, ["k"], "e").first().e == "x"
    levels = df.withColumn("level", F.when(F.col("e") == "z", 0).otherwise(1))
    assert rows(weights.best_level(levels, ["k"]), "k", "e") == [("a", "z"), ("b", "x")]
    queue = spark.createDataFrame([("q", "r", 0.5), ("q", "s", 0.9), (None, "q", None)], "parent string, node string, weight double")
    assert rows(weights.queue_max(queue, "parent", "node")) == [("q", 0.7), ("r", 0.5), ("s", 0.9)]


def test_standing(spark):
    votes = spark.createDataFrame([("a", "INDIVIDUAL", 3.0), ("a", "COLLECTION", 1.0), ("a", "UNKNOWN", 9.0), ("b", "UNKNOWN", 1.0)], "key string, kind string, weight double")
    t = {r.key: r for r in standing.with_share(standing.tally(votes, ["key"])).collect()}
    assert (t["a"].total, t["a"].ind_share, t["b"].ind_share) == (4.0, 4 / 6, 0.5)
    n = {r.key: r for r in standing.against_global(standing.tally(votes, ["key"])).collect()}
    assert abs(n["a"].ind - 2 / 3) < 1e-9 and n["a"].total == 1.0 and n["b"].total == 0.0
    parts = spark.createDataFrame([("a", 1, 0.0, 0.0, 1.0, 0.0), ("a", 2, 3.0, 1.0, 0.0, 4.0), ("a", 3, 1.0, 0.0, 0.0, 1.0)], "key string, o int, ind double, coll double, unk double, total double")
    m = standing.merge(parts, ["key"], "o").first()
    assert abs(m.ind - (2 / 3 + 1)) < 1e-9 and m.total == 2.0 and m.unk == 1.0


def test_closure_ends_in_cycles(spark):
    direct = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "a")], "arg1 string, arg2 string")
    got = {(r.node, r.ancestor): r.depth for r in graph.closure(direct).collect()}
    assert got[("d", "c")] == 3 and got[("a", "a")] == 0 and len(got) == 13
    assert graph.closure(direct.filter("false")).count() == 0


def test_graph(spark):
    direct = spark.createDataFrame([("dog", "pet"), ("cat", "pet"), ("pet", "animal"), ("rock", "thing"), ("animal", "thing")], "arg1 string, arg2 string")
    up = graph.closure(direct)
    dis = graph.disjoint_pairs(spark.createDataFrame([("animal", "rock")], "arg1 string, arg2 string"), up)
    assert rows(dis) == [("animal", "rock"), ("cat", "rock"), ("dog", "rock"), ("pet", "rock")]
    assert rows(graph.generalise(dis, up)) == [("animal", "rock")]
    members = spark.createDataFrame([("k", "dog"), ("k", "pet"), ("k", "rock")], "key string, member string")
    assert rows(graph.minimal(members, up), "member") == [("dog",), ("rock",)]
    assert graph.justify(direct, "dog", "thing").first().path == ["dog", "pet", "animal", "thing"]
    assert graph.justify(direct, "rock", "dog").count() == 0
    assert rows(graph.siblings(direct)) == [("animal", "rock"), ("cat", "dog"), ("dog", "cat"), ("rock", "animal")]
    d = {(r.a, r.b): r.distance for r in graph.semantic_distance(spark.createDataFrame([("dog", "cat"), ("dog", "dog")], "a string, b string"), up, graph.isa_closure(spark.createDataFrame([], "arg1 string, arg2 string"), up), 6).collect()}
    assert d[("dog", "dog")] == 0 and d[("dog", "cat")] == (4 - 3) / (6 - 4)


def test_triple_patterns(spark):
    t = spark.createDataFrame([("a", "likes", "b"), ("b", "likes", "c"), ("a", "age", "3"), ("c", "likes", "c")], "s string, p string, o string")
    assert rows(lookups.match(t, ("?x", "likes", "?y"), ("?y", "likes", "?z")), "x", "y", "z") == [("a", "b", "c"), ("b", "c", "c"), ("c", "c", "c")]
    assert rows(lookups.match(t, ("?x", "likes", "?x"))) == [("c",)]
    both = lookups.match_optional(lookups.match(t, ("?x", "likes", "?y")), t, ("?x", "age", "?n"))
    assert rows(both, "x", "n") == [("a", "3"), ("b", None), ("c", None)]
    assert lookups.ask(lookups.match(t, ("z", "likes", "?y"))).first().answer is False


def test_annotations(spark):
    texts = spark.createDataFrame([(1, "the New York times")], "id int, text string")
    labels = spark.createDataFrame([("new york", 1), ("york", 2), ("new york times", 3), ("the", 4)], "label string, target int")
    found = lookups.annotate(texts, labels)
    assert found.count() == 4
    assert rows(lookups.longest_annotations(found), "label") == [("new york times",), ("the",)]


def test_gold_lines(spark):
    lines = spark.createDataFrame([("(isa mapArt('1') mapArt('2'))",), ("(isa mapArt('9') x)",), ("(isa a b)",)], "line string")
    mapping_ = spark.createDataFrame([(1, "Dog"), (2, "Animal")], "article_id int, concept string")
    assert rows(lookups.with_gold(lines, mapping_)) == [("(isa Dog Animal)",), ("(isa a b)",)]


def test_redirects(spark):
    found = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 2.0), ("s", 7, 4.0), ("s", 5, 1.0)], "source string, target int, weight double")
    red = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "src int, dst int")
    assert rows(mapping.follow_redirects(found, red)) == [("s", 3, 3.0), ("s", 7, 4.0)]


def test_matching(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (2, "a", 0.85), (2, "c", 0.1), (3, "c", 0.5)], "article int, concept string, weight double")
    assert rows(mapping.greedy_one_to_one(df), "article", "concept") == [(1, "a"), (3, "c")]
    assert mapping.greedy_one_to_one(df.filter("false")).count() == 0
    assert mapping.configured(["% off", " title match ", "", "%x", "label vote"]) == ["title match", "label vote"]
    assert set(mapping.configured(["title match"])) <= set(mapping.HEURISTICS)


def test_fragments(spark):
    t = spark.createDataFrame([(1, "big red dog"), (2, ""), (3, "a a")], "id int, text string")
    got = rows(mapping.fragments(t))
    assert (1, 0, "big red dog") in got and (1, 1, "red dog") in got and (1, 2, "red") in got and len([g for g in got if g[0] == 1]) == 6
    assert [g for g in got if g[0] == 3] == [(3, 0, "a a"), (3, 1, "a")] and not [g for g in got if g[0] == 2]
    names = spark.createDataFrame([("Red Dog", "RD"), ("dog", "D")], "name string, concept string")
    assert rows(mapping.fragment_search(t, names)) == [(1, "red dog", "RD")]


def test_solver_agrees_with_all_subsets(spark):
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(60):
        cells = [(x, 0, f"a{rng.randrange(8)}", rng.choice([0.2, 0.5, 0.9, 1.0])) for x in range(5)]
        cells += [(x, 1, f"a{rng.randrange(8)}", 0.1) for x in range(0, 5, 2)]
        dis = {tuple(sorted(p)) for p in (rng.sample([f"a{i}" for i in range(8)], 2) for _ in range(8))}
        by_x = [[c for c in cells if c[0] == x] + [None] for x in range(5)]
        best = 0.0
        for pick in itertools.product(*by_x):
            got = [c for c in pick if c]
            if all(tuple(sorted((a[2], b[2]))) not in dis for a, b in itertools.combinations(got, 2)):
                best = max(best, sum(c[3] for c in got))
        total = sum(max(c[3] for c in col if c) for col in by_x)
        w, chosen = consistency.largest_consistent(cells, dis)
        assert abs(w - best / total) < 1e-9
        assert all(tuple(sorted(p)) not in dis for p in itertools.combinations(chosen, 2))


def test_grid_and_solve(spark):
    queues = spark.createDataFrame([(1, "q", None, "isa dog", 1.0), (1, "q", None, "isa cat", 0.5), (1, "r", "q", "isa pet", 0.8), (1, "t", "q", "isa rock", 0.9), (2, "u", None, "x", 0.3)], "module int, queue string, parent string, assertion string, weight double")
    g = consistency.grid(queues)
    assert rows(g.filter("module = 1"), "x", "y", "assertion", "weight") == [(0, 0, "isa dog", 1.0), (0, 1, "isa cat", 0.5), (1, 2, "isa pet", 0.4), (2, 2, "isa rock", 0.45)]
    dis = spark.createDataFrame([("isa dog", "isa rock"), ("isa pet", "isa rock"), ("isa cat", "isa rock")], "a string, b string")
    got = {r.module: r for r in consistency.solve(g, dis).collect()}
    assert sorted(got[1].assertions) == ["isa dog", "isa pet"] and got[2].weight == 1.0
    known = spark.createDataFrame([(1, "isa rock")], "module int, assertion string")
    assert {r.module: r.assertions for r in consistency.solve(g, dis, known).collect()}[1] == ["isa rock"]


def test_accept_and_status(spark):
    c = spark.createDataFrame([("s", "a", 0.9), ("s", "b", 0.8), ("s", "c", 0.7)], "subject string, assertion string, weight double")
    assert rows(consistency.accept(c, spark.createDataFrame([("a", "b")], "a string, b string")), "assertion") == [("a",), ("c",)]
    new = spark.createDataFrame([("isa", "x", "y"), ("isa", "x", "z"), ("isa", "x", "w")], "pred string, arg1 string, arg2 string")
    assert rows(consistency.status(new, new.filter("arg2 = 'y'"), new.filter("arg2 = 'w'")), "arg2", "status") == [("w", -1), ("y", 0), ("z", 1)]


def test_evaluation(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.4), (False, 0.1), (False, 0.7), (False, 0.1)], "truth boolean, score double")
    m = evaluate.at_threshold(df).first()
    assert abs(m.threshold - 0.475) < 1e-9 and (m.tp, m.fp, m.fn, m.tn) == (1, 1, 1, 2) and m.accuracy == 0.6
    p = spark.createDataFrame([("a", "b", "disjoint"), ("b", "a", "conjoint"), ("c", "a", "disjoint"), ("a", "c", "disjoint")], "a string, b string, label string")
    assert rows(evaluate.without_contradicted(p)) == [("a", "c")]
    train = spark.createDataFrame([(float(i), float(i % 5), float(i >= 20)) for i in range(40)], "x double, z double, label double")
    model = evaluate.disjoint_model(train, ["x", "z"], rounds=3)
    assert model.transform(train).filter("prediction = label").count() >= 38
    assert evaluate.hash_sample(train, "x", 7).count() == 7


def test_mining(spark):
    a = spark.createDataFrame([(1, "Big Red Dog"), (2, "Big red dog, the"), (3, "Dog"), (4, "List of big dogs")], "article_id int, title string")
    assert rows(mining.title_standing(a), "article_id", "kind") == [(1, "INDIVIDUAL"), (2, "COLLECTION")]
    c = spark.createDataFrame([(1, "Jo", "1900 births"), (1, "Jo", "Painters stubs"), (1, "Painter", "Painters"), (1, "Jo", "1950s deaths")], "article_id int, title string, category string")
    assert rows(mining.categories(c), "relation", "arg") == [("birthDate", "1900"), ("deathDate", "1950"), ("isaGenls", "Painters")]
    m = spark.createDataFrame([(1, "{{Infobox x|image=A b.jpg|website=u|caption=c|p2=[[q]]}}'''Jo''' is a [[cat]]. More."), (2, None)], "article_id int, markup string")
    assert rows(mining.infobox_relations(m), "relation", "arg") == [("conceptImage", "A_b.jpg"), ("homepage", "u"), ("p", "[[q]]")]
    # `X is a Y` says nothing of X's standing; `A X is a Y` speaks for both.
    more = spark.createDataFrame([(3, "{{a}}<ref>b</ref>\nA '''cat''' is a [[pet]]. More.")], "article_id int, markup string")
    assert rows(mining.first_sentence(m.union(more)), "article_id", "kind") == [(3, "COLLECTION"), (3, "INDIVIDUAL")]
    assert more.select(wikitext.sentence_fragment(F.lit("'''Jo''' is a [[cat]] of old.")).alias("f")).first().f == "[[cat]] of old."
    assert rows(mining.sentence_synonyms(m), "arg") == [("Jo",)]
    assert mining.wanted(mining.COMMENT) == ["first sentence"]
    votes = spark.createDataFrame([("t", "x")] * 29 + [("t", "y")] + [("u", "x")], "k string, v string")
    assert rows(mining.majority(votes, "k", "v"), "k", "v") == [("t", "x")]
    rows_ = spark.createDataFrame([("isa", ["1", "2"]), ("likes", ["1", "b", "3"])], "relation string, args array<string>")
    assert rows(mining.by_subject(rows_), "relation", "subject") == [("isa", "1"), ("likes", "1"), ("likes", "3")]


def test_precomputed_store(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([("h", 1, "a"), ("h", 9000, "b"), ("g", 1, "c")], "heuristic string, article_id long, value string")
    stores.write_precomputed(one, root)
    stores.write_precomputed(spark.createDataFrame([("h", 2, "new")], "heuristic string, article_id long, value string"), root)
    assert rows(stores.read_precomputed(spark, root, "h"), "article_id", "value") == [(2, "new"), (9000, "b")]
    keys = spark.createDataFrame([(9000,)], "article_id long")
    assert rows(stores.read_precomputed(spark, root, "h", keys), "value") == [("b",)]
    stores.write_tsv(one.select("article_id", "value"), str(tmp_path / "t"))
    assert stores.read_tsv(spark, str(tmp_path / "t"), "id long, value string").count() == 3
    assert stores.scan_listed(spark, str(tmp_path / "t"), one, "article_id").count() == 3


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "event_id long, user_id long").coalesce(1).write.mode("append").parquet(src)
    stream = incremental.trigger_stream(spark, src, "event_id long, user_id long")
    run = lambda: incremental.drain(incremental.run_version_stream(stream), str(tmp_path / "ck"), lambda df, _: df.write.mode("append").parquet(out), "update").awaitTermination()
    run()
    spark.createDataFrame([(4, 5)], "event_id long, user_id long").coalesce(1).write.mode("append").parquet(src)
    run()
    last = spark.read.parquet(out).groupBy("user_id").agg(F.max("runs").alias("runs"))
    assert rows(last) == [(5, 3), (6, 1)]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 1)], "k int, v string, part int").write.partitionBy("part").parquet(path)
    incremental.upsert(spark, path, spark.createDataFrame([(2, "x", 0), (3, "c", 1), (4, "n", 0)], "k int, v string, part int"), ["k"], "part")
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "x"), (3, "c"), (4, "n")]
