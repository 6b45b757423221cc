import random

import pytest

WORDS = "the of and cat dog house river stone green old walk light wind north copy data engine table Row line word paper été über 日本 a.b it's 42 x,y".split()


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): unlike texts, near and exact copies, shared passages, null, empty and blank texts, repeated rows."""
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) + str(rng.randrange(40)) for _ in range(k))
    passage = make(70)
    out: list[tuple] = []
    for i in range(n):
        kind = i % 10
        if kind == 4 and out:
            text = out[i - 1][1]
        elif kind == 5 and out:
            w = out[i - 3][1].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 6:
            text = make(20) + "\n" + passage + "\n" + make(30)
        elif kind == 7:
            text = make(rng.randrange(1, 5))
        else:
            text = "\n".join(make(rng.randrange(5, 90)) for _ in range(3))
        out.append((i * 3, text, f"s{i % 3}"))
    return [*out, (1000, None, "s0"), (1001, "", None), (1002, " \t\n ", "s1"), (None, make(60), "s1"), out[0], (out[1][0], make(55), "s2")]


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("id", "row", "th", "n_words", "key", "kept", "pad", "fp_words", "block")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")
