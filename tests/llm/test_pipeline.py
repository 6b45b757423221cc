"""The pipeline against a brute-force version."""

import re
from collections import Counter

from .conftest import corpus
from .test_documents import WORD, components, removed


def brute(data):
    """(doc_id, kept words) after quality rules, near-duplicates and repeated passages; keys in data are distinct."""
    good = []
    for i, t, _ in data:
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        g = [False] * len(w)
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                g[k : k + 5] = [True] * 5
        if len(w) >= 10 and 100 * sum(g) <= 20 * len(w):
            good.append((i, t))
    root, _ = components(good, 5)
    alone = [(i, t) for i, t in good if root[i] == i]
    return {i: n - k for i, n, k, _ in removed(alone)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from lorewell.llm.common import written

    data = [r for k, r in enumerate(corpus()) if r[0] is not None and r[0] not in {x[0] for x in corpus()[:k]}]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == df.columns, name
    want = brute(data)
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: len(WORD.findall(r.text)) for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(want)
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names
