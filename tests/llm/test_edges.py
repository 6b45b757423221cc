"""Very long texts, ties, repeated rows and clashing columns; brute force for verdicts and main text."""

import hashlib
import random
import zlib
from array import array
from collections import Counter, defaultdict

import pytest

from .test_documents import WORD, removed


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 60,000 words, one with its last word changed, a short copy of its middle and an empty one; names clash."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(60000)]
    lines = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    data = [(1, "\n".join(lines)), (2, "\n".join(lines)[:-1] + "!"), (3, " ".join(words[30000:30100])), (4, ""), (4, "")]
    return data, spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'s' as source", "7 as id", "8 as th", "9 as n", "10 as kept", "11 as head")


def test_long_near(long_docs):
    from lorewell.llm.near_dedup import near_components, near_filter

    data, df = long_docs
    got = sorted((r.id, r.component_id) for r in near_components(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4)]
    assert near_filter(df).columns == df.columns


def test_long_tokens(spark, long_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lorewell.llm.packing import pack
    from lorewell.llm.piece_tokens import best_path
    from lorewell.llm.token_output import read_tokens, write_tokens

    data, df = long_docs
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [1] for _, t in data]
    pieces = pack(df, path).collect()
    for (i, _), ids in list(zip(data, want))[:3]:
        mine = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert [s for s, _, _ in mine] == [0, *[s + n for s, n, _ in mine][:-1]] and sum(n for _, n, _ in mine) == len(ids)
        assert all(c == zlib.crc32(array("I", ids[s : s + n]).tobytes()) for s, n, c in mine)
    back = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in read_tokens(write_tokens(df, f"file://{tmp_path}/t", path)).collect()}
    assert back == {(i, len(ids), zlib.crc32(array("I", ids).tobytes())) for (i, _), ids in zip(data, want)}
    model = public_tokenizers.path("piece_bpe_32k.model")
    by_scan, at_once = (sorted(tuple(r) for r in best_path(df, model, giant=g).collect()) for g in (1 << 16, 1 << 30))
    assert by_scan == at_once and all(r[4] for r in by_scan)


def test_long_passages_and_licences(long_docs):
    from lorewell.llm.fingerprints import add_fingerprint
    from lorewell.llm.license_scan import scan
    from lorewell.llm.substring_dedup import substring_dedup

    data, df = long_docs
    out = substring_dedup(df)
    new = [c for c in out.columns if c not in df.columns]
    assert sorted((tuple(r[c] for c in ("doc_id", *new)) for r in out.collect()), key=repr) == removed(data)
    assert {(r.id, r.n_words) for r in scan(df).collect()} == {(i, len(t.replace("!", "").split())) for i, t in data}
    prints = {r.doc_id: r.fp for r in add_fingerprint(df, "text", "fp").collect()}
    assert sum(a == b for a, b in zip(prints[1], prints[2])) > 240 and prints[4] == ""


def test_whole_licence_text(spark):
    """An exact copy of a template of any length has every position, wherever it stands and whatever surrounds it."""
    from lorewell.llm.license_scan import scan, template_rows
    from lorewell.llm.license_templates import TEXTS

    rng = random.Random(2)
    noise = lambda: " ".join(f"n{rng.randrange(99)}" for _ in range(50))
    data = [(i, f"{noise()} {text} {noise()}") for i, (_, text) in enumerate(TEXTS)]
    own = (" ".join(f"k{i}" for i in range(300)))
    got = {r.id: r for r in scan(spark.createDataFrame(data + [(50, f"x {own} y")], "doc_id long, text string"), notices=(*TEXTS, ("own", own))).collect()}
    for i, (label, _) in enumerate(TEXTS):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    assert (got[50].labels, got[50].score) == ("own", 1.0)
    assert max(r[4] for r in template_rows()) > 150


def verdicts(data, least=5, fewest=2, half=0.5, share=0.01):
    """kept of each (id, text, host) by the rules' description."""
    docs, holds, texts, first = Counter(), Counter(), defaultdict(set), {}
    norm = lambda line: "".join("0" if "0" <= c <= "9" else c.lower() if "A" <= c <= "Z" else c for c in " ".join(WORD.findall(line)))
    for i, t, h in data:
        docs[h] += 1
        for line in {norm(x) for x in t.split("\n")} - {""}:
            holds[h, line] += 1
            texts[h, line].add(t)
            first[h, line] = min(i, first.get((h, line), i))
    out = {}
    for i, t, h in data:
        w = WORD.findall(t)
        limit = max(min(least, max(fewest, docs[h] * half)), docs[h] * share)
        often = lambda x: len(texts[h, x]) > 1 and holds[h, x] > limit and first[h, x] < i
        gone = sum(len(WORD.findall(x)) for x in t.split("\n") if norm(x) and often(norm(x)))
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        out[i] = (not failed and not (gone and (len(w) - gone < 10 or len(w) - gone < 0.3 * len(w))), gone)
    return out


def test_verdicts_by_brute_force(spark):
    from lorewell.llm.quality_rules import quality_facts

    rng = random.Random(21)
    pool = [" ".join(rng.choice("Alpha beta 12 345 gamma, Delta. x".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 30))) for _ in range(40)]
    data = []
    for i in range(300):
        lines = [rng.choice(pool[: 1 + i % 40]) if rng.random() < 0.6 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 7))]
        data.append((i, "\n".join(lines), f"h{min(i % 7, 4)}"))
    data[50] = (50, data[49][1], data[50][2])
    got = {r.id: (r.kept, r.n_removed_words) for r in quality_facts(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    want = verdicts(data)
    assert got == want
    assert len({k for k, _ in want.values()}) == 2 and sum(g > 0 for _, g in want.values()) > 50


def test_main_text_of_generated_pages():
    """Pages put together from article blocks and everything else give the article's blocks, with or without an article element."""
    from lorewell.llm.html_text import main_text

    rng = random.Random(31)
    say = lambda a, b: " ".join(f"word{rng.randrange(999)}" for _ in range(rng.randrange(a, b)))
    junk = [
        lambda: f"<nav><ul><li><a href=/a>{say(1, 4)}</a></ul></nav>",
        lambda: f'<div class="sidebar-left"><p>{say(10, 90)}</p></div>',
        lambda: f"<script>var a='<p>{say(3, 9)}</p>'</script><style>p{{}}</style>",
        lambda: f'<div id="cookie-notice">{say(5, 60)}<button>ok</button></div>',
        lambda: f"<form><label>{say(1, 5)}</label><input name=q></form>",
        lambda: f'<section class="comments"><article class="comment"><p>{say(20, 80)}</p></article></section>',
        lambda: f"<aside>{say(5, 80)}</aside>",
        lambda: f'<div class="ad">{say(3, 50)}</div>',
    ]
    for _ in range(200):
        whole = rng.random() < 0.7
        blocks = [say(2, 9)] + [say(1, 60) if whole else say(30, 80) for _ in range(rng.randrange(1, 9))]
        body = f"<header><h1>{blocks[0]}</h1><p>by {say(2, 3)}</p></header>" if whole else f"<h1>{blocks[0]}</h1>"
        for k, b in enumerate(blocks[1:]):
            # Without an article element a heading belongs to the text that follows it at once.
            body += (rng.choice(junk)() if rng.random() < 0.3 and (whole or k) else "") + rng.choice(["<p>{}</p>", "<p>{}", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).format(b.replace(" ", rng.choice([" ", "\n  ", " <b>", "&#32;"]), 1))
        around = ["".join(rng.choice(junk)() for _ in range(rng.randrange(3))) for _ in range(2)]
        page = f"<html><head><title>{say(1, 5)}</title></head><body><header>{say(2, 30)}</header>{around[0]}" + (f"<article>{body}</article>" if whole else f"<div>{body}</div>") + f"{around[1]}<footer>{say(3, 40)}</footer></body></html>"
        assert main_text(page) == "\n\n".join(blocks), page


def test_equal_sums_are_no_surge():
    from lorewell.llm.html_text import SURGE, WINDOW, between, line_weights

    assert between([SURGE, 0, 0, 0, 0, 2 * SURGE]) == [(5, 6)]
    assert between([SURGE + 1] + [0] * WINDOW) == [(0, 1)]
    assert line_weights([("ab", True, 0.0), ("menu", False, 0.0), ("", True, 0.0)]) == [2 + SURGE, 0, 0]
    assert line_weights([("ab", True, 0.0), ("x" * 90, False, 0.0), ("y" * 50, False, 0.9)]) == [2 + SURGE, 90, 0]


def test_warc_edges(spark, tmp_path):
    """Empty, long and repeated payloads; ties of the greatest key; archives are read one file a task."""
    from lorewell.llm.warc import read_archives, resolve_revisits, write_archives

    long = "<p>" + "long text " * 200000
    data = [(1, "u", ""), (2, "u", long), (3, "u", long), (3, "u", long), (4, None, None)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as original", "3 as n")
    files = write_archives(df.repartition(4), f"file://{tmp_path}/w", file_bytes=1)
    files.write.parquet(f"{tmp_path}/files")
    listed = spark.read.parquet(f"{tmp_path}/files")
    records = read_archives(listed)
    assert records.rdd.getNumPartitions() == listed.count() == 5
    got = sorted((r.key, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else hashlib.sha1(r.payload).hexdigest() == r.digest) for r in resolve_revisits(records).collect())
    n = len(long)
    assert got == [(1, "response", None, 0, True), (2, "revisit", 3, n, None), (3, "response", None, n, True), (3, "response", None, n, True), (4, "response", None, 0, True)]


def test_repeated_keys_over_shards(spark, tmp_path):
    import public_tokenizers

    from lorewell.llm.token_output import TokenReader, write_tokens

    data = [(None, f"text {i:03d}") for i in range(30)] + [(5, "a b"), (5, "a b"), (-(1 << 62), "low"), ((1 << 62), "high")]
    man = write_tokens(spark.createDataFrame(data, "doc_id long, text string"), f"file://{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"), shard_docs=7)
    reader = TokenReader(man, most=2)
    assert len(reader.get(None)) == 30 and len(reader.get(5)) == 2 and len(reader.get(1 << 62)) == 1 == len(reader.get(-(1 << 62)))


def test_packing_of_any_key(spark):
    import public_tokenizers

    from lorewell.llm.packing import pack

    data = [((1 << 63) - 1, "a b c"), (-(1 << 63), "d"), (None, "e"), (None, "f"), (0, None)]
    out = pack(spark.createDataFrame(data, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in out} == {i for i, _ in data}
    assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)


@pytest.mark.parametrize("hot", [4, 2048])
def test_spread_join(spark, hot, monkeypatch):
    """Keys of any type, hot ones by broadcast and others by shuffle, rows of nulls and without a partner."""
    from lorewell.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    data = [("deadbeef", i) for i in range(60)] + [(f"k{i % 7}", i) for i in range(20)] + [(None, 1)]
    rows = spark.createDataFrame(data, "d string, i int").repartition(3)
    few = rows.groupBy("d").count().withColumnRenamed("count", "n").filter("d is not null and d <> 'k3'").selectExpr("d", "n", "upper(d) as v")
    got = sorted((tuple(r) for r in common.spread_join(rows, few, ["d"], len(data)).collect()), key=repr)
    assert got == sorted(((d, i, None if d in (None, "k3") else d.upper()) for d, i in data), key=repr)
