"""Boilerplate in long runs, in copies and on small hosts."""

import random


def test_frequent_lines_of_every_kind(spark):
    from lorewell.llm.quality_rules import quality_facts

    rng = random.Random(4)
    body = lambda k=40: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    foot, line, copied = body(60), body(12), body()
    data = [(i, f"{body()}\n{foot}", "long") for i in range(60)] + [(60, foot, "long")]
    data += [(100 + 20 * i + k, t, "copies") for i, t in enumerate([f"{body()}\n{line}" for _ in range(4)]) for k in range(20)]
    data += [(200 + i, f"{body()}\n{line}", "small") for i in range(9)] + [(210 + i, body(), "small") for i in range(3)]
    data += [(300 + i, copied, "one text") for i in range(80)]
    f = {r.id: r for r in quality_facts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    # A footer of more than 50 words goes, and a document of nothing else is depleted.
    assert not f[0].removed_lines and all(f[i].removed_lines == [1] and f[i].n_removed_words == 60 and f[i].kept for i in range(1, 60))
    assert f[60].n_removed_words == 60 and f[60].depleted and not f[60].kept
    # Copies are documents; a host may be small; copies of one text are no boilerplate.
    assert [f[i].removed_lines for i in (100, 101, 179)] == [[], [1], [1]]
    assert [f[i].n_removed_words for i in (200, 201, 208, 210)] == [0, 12, 12, 0]
    assert all(f[300 + i].kept and not f[300 + i].n_removed_words for i in range(80))
