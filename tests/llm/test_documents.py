"""Operators on documents against brute force, with null, empty, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from .conftest import corpus

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(data, k, percent=80):
    keyed = [(i, shingles(t, k)) for i, t, *_ in data]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keyed)):
        for b in range(a):
            (i, s), (j, t) = keyed[a], keyed[b]
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, s in keyed if i is not None}, keyed


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(spark, docs, k):
    from lorewell.llm.near_dedup import near_components

    data = [r for r in corpus() if r[0] != 3]  # a key with two texts has its own test
    want, keyed = components(data, k)
    got = rows(near_components(docs.filter("doc_id is null or doc_id <> 3"), k=k), "id", "n_shingles", "component_id")
    assert got == sorted(((i, len(s), None if i is None else want[i] if s else i) for i, s in keyed), key=repr)
    assert len({c for _, n, c in got if n}) < len([g for g in got if g[1]])


def test_near_components_large_bucket(spark):
    """A group larger than a small bucket, with members at all distances from its centre."""
    from lorewell.llm.near_dedup import SMALL, near_components

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    data = []
    for i in range(4 * SMALL):
        w = list(base)
        for p in rng.sample(range(150), int(abs(rng.gauss(0, 9)))):
            w[p] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(w)))
    rng.shuffle(data)
    want, _ = components(data, 2)
    got = dict(rows(near_components(spark.createDataFrame(data, "doc_id long, text string"), k=2), "id", "component_id"))
    assert got == want
    assert len(set(got.values())) > 1


def test_estimate_is_unbiased():
    from lorewell.llm.near_dedup import estimate, registers

    rng = np.random.Generator(np.random.PCG64(1))
    err = []
    for _ in range(20):
        common, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (300, 60, 60))
        x, y = np.concatenate((common, a)), np.concatenate((common, b))
        reg = registers(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), 200)
        err.append(estimate(reg[:1], reg[1:], np.array([len(x)]), np.array([len(y)]))[0] - 300 / 420)
    assert abs(np.mean(err)) < 0.03


def test_near_filter_keeps_one_of_each(spark, docs, empty):
    from lorewell.llm.near_dedup import near_filter

    out = near_filter(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    want, keyed = components([r for r in corpus() if r[0] != 3], 5)
    stay = {i for i, s in keyed if i is not None and want[i] == i}
    assert {i for i, _ in got if i not in (3, None)} == stay - {3}
    assert len(got) == len(set(got))
    assert near_filter(empty).count() == 0


def removed(data):
    first, out = {}, []
    for i, t in sorted(data, key=lambda r: float("inf") if r[0] is None else r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), float("inf") if i is None else i)
    for i, t in data:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < (float("inf") if i is None else i):
                gone[k : k + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [3, 2048])
def test_substring_dedup(spark, docs, empty, hot, monkeypatch):
    from lorewell.llm import common
    from lorewell.llm.substring_dedup import substring_dedup

    monkeypatch.setattr(common, "HOT", hot)  # windows join by shuffle, or all by broadcast
    out = substring_dedup(docs)
    new = [c for c in out.columns if c not in docs.columns]
    assert out.columns[: len(docs.columns)] == docs.columns and len(new) == 3
    data = [(i, t) for i, t, _ in corpus()]
    want = removed(data)
    assert rows(out, "doc_id", *new) == want and sum(w[2] for w in want) > 100
    for r in out.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == r["kept_sha256"]
    assert substring_dedup(empty).count() == 0


def test_quality_facts(spark, docs, empty):
    from lorewell.llm.quality_rules import quality_facts, quality_filter

    want = []
    for i, t, _ in corpus():
        w = WORD.findall(t or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        g = [False] * len(w)
        for k in range(len(w) - 4):
            if c[tuple(w[k : k + 5])] > 1:
                g[k : k + 5] = [True] * 5
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), sum(g), len(w) < 10 or 100 * sum(g) > 20 * len(w)))
    got = quality_facts(docs)
    assert rows(got, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    kept = quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(w[0]) for w in want if not w[6])
    assert quality_filter(empty).count() == 0


def test_boilerplate_lines(spark):
    """A line on many texts of a host goes from all but the first; texts that are nothing else are rejected."""
    from lorewell.llm.quality_rules import quality_facts, quality_filter

    rng = random.Random(2)
    body = lambda: " ".join(f"w{rng.randrange(10**5)}" for _ in range(40))
    line = "Accept all cookies to go on reading this page now please 7"
    data = [(i, f"{line}\n{body()}", "h") for i in range(30)] + [(100, line + "\nx y", "h"), (101, line.upper() + "\n" + body(), "other"), (102, body(), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    facts = {r.id: r for r in quality_facts(df, least=5, share=0.1).collect()}
    assert not facts[0].removed_lines and facts[1].removed_lines == [0] and not facts[101].removed_lines
    assert not facts[100].kept and not facts[100].base_failed and all(facts[i].kept for i in range(30))
    texts = {r.doc_id: r.text for r in quality_filter(df, least=5, share=0.1).collect()}
    assert line in texts[0] and line not in texts[1] and 100 not in texts


PATHS = ["byte_bpe_50k.json", "word_bpe_49k.json"]
HARD = ["", " ", "a b  c\n\nd", "\n", "foo\nBar baz.\n", "it's can't\nI'll x's!", "a\tb \t c", "İstanbul ΣΑΣ, étude\ńx", "a b 　 c", "日本語 テスト。ok", "12 345,678 9.", "<|endoftext|> hi", "!!\n!! ??", "é, É! ê÷, …, don't, (foo) --- ---a", "a\xa0b c", "A\n,B\n.C", "\x00 a\x00 b"]


@pytest.mark.parametrize("name", PATHS)
def test_encoder_is_the_library(name):
    import public_tokenizers
    import pyarrow as pa

    from lorewell.llm.tokens import encoded, encoder

    path = public_tokenizers.path(name)
    rng = random.Random(4)
    texts = HARD * 2 + ["".join(rng.choice(" \n\t,.'abcé日!0") for _ in range(rng.randrange(60))) for _ in range(2000)] + [t or "" for _, t, _ in corpus()]
    got = list(encoded(pa.record_batch({"text": pa.array(texts)}), "text", path, 1))
    want = encoder(path).tok.encode_batch(texts, add_special_tokens=False)
    for t, g, e in zip(texts, got, want):
        assert g.tolist() == e.ids + [1], t


def cost(ends, penalty, width, hard):
    total, at = 0, 0
    for e in ends:
        assert 0 < e - at <= width
        total += (0 if (e - at) & (e - at - 1) == 0 else width - (e - at)) + (penalty.get(e, hard) if e != ends[-1] else 0)
        at = e
    return total


def test_cut_is_optimal():
    from lorewell.llm.packing import cut

    rng = random.Random(6)
    for _ in range(1500):
        width, at, points = rng.choice([4, 8, 12, 16, 32]), 0, []
        for _ in range(rng.randrange(1, 25)):
            at += rng.randint(1, width // 2)
            points.append(at)
        hard = rng.choice([1, 3, 5])
        penalty = [rng.choice([0, 1, min(3, hard)]) for _ in points[:-1]] + [0]
        pos, best = [0, *points], [0]
        quarter = {1 << k for k in range(max(width.bit_length() - 3, 0), width.bit_length())}
        for j in range(1, len(pos) - 1):
            best.append(min(best[i] + (0 if pos[j] - pos[i] in quarter and pos[j] - pos[i] < width else width - pos[j] + pos[i]) + penalty[j - 1] for i in range(j) if pos[j] - pos[i] <= width))
        n = lambda i: pos[-1] - pos[i]
        want = min(best[i] + min(width - n(i), hard * (n(i).bit_count() - 1)) for i in range(len(pos) - 1) if n(i) <= width)
        assert cost(cut(points, penalty, width, hard), dict(zip(points, penalty)), width, hard) <= want


def test_packing(spark, docs, empty):
    import public_tokenizers

    from lorewell.llm.packing import pack
    from lorewell.llm.tokens import encoder

    path = public_tokenizers.path(PATHS[0])
    out = pack(docs, path, width=256, flush=2000).collect()
    sequences, pieces = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    left = Counter()
    for i, t, _ in corpus():
        ids = encoder(path).tok.encode(t or "", add_special_tokens=False).ids + [1]
        left[(i, len(ids))] += len(ids)
        mine = pieces[(i, len(ids))]
        right = {(s, n) for s, n, crc in mine if crc == zlib.crc32(array("I", ids[s : s + n]).tobytes())}
        reached = {0}  # pieces of this text follow each other without a gap; a repeated row may be cut elsewhere
        for s, n in sorted(right):
            reached |= {s + n} if s in reached else set()
        assert len(ids) in reached
    assert sum(left.values()) == sum(r.length for r in out)
    assert pack(empty, path).count() == 0


def test_token_output(spark, docs, empty, tmp_path):
    import public_tokenizers

    from lorewell.llm.token_output import TokenReader, read_tokens, write_tokens
    from lorewell.llm.tokens import encoder

    path = public_tokenizers.path(PATHS[1])
    man = write_tokens(docs, f"file://{tmp_path}/a", path, shard_docs=10)
    got = rows(read_tokens(man), "doc_id", "start", "n_tokens", "ids_crc32", "in_index")
    start, want, by_key = 0, [], {}
    for i, t in sorted(((i, t or "") for i, t, _ in corpus()), key=lambda r: (-1 if r[0] is None else r[0], r[1].encode())):
        ids = encoder(path).tok.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes()), True))
        by_key.setdefault(i, []).append(ids)
        start += len(ids)
    assert got == sorted(want, key=repr)
    reader = TokenReader(man)
    for key, ids in by_key.items():
        assert [x.tolist() for x in reader.get(key)] == ids
    assert reader.get(999_999) == []
    assert read_tokens(write_tokens(empty, f"file://{tmp_path}/b", path)).count() == 0


def test_perfect_hash():
    from lorewell.llm.token_output import _mix, build_mph, find

    keys = np.random.Generator(np.random.PCG64(2)).choice(1 << 40, 20000, replace=False).astype(np.uint64)
    pilots, slots = build_mph(keys)
    assert sorted(slots) == list(range(len(keys)))
    finger = np.empty(len(keys), np.uint32)
    finger[slots] = (_mix(keys, 3) >> np.uint64(32)).astype(np.uint32)
    assert (find(keys, {"pilots": pilots, "finger": finger}) == slots).all()
    strange = keys[:1000] + np.uint64(1 << 41)
    assert (find(strange, {"pilots": pilots, "finger": finger}) >= 0).sum() <= 1


def test_fingerprints(spark, docs, empty, tmp_path):
    from lorewell.llm.fingerprints import op3_fingerprints

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_fingerprints(spark, str(tmp_path)).collect()
    data = sorted(((i, t or "") for i, t, _ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = []
    for k, (i, t) in enumerate(data):
        n, c = data[(k + 1) % len(data)][1], len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {}
    for r in got:
        if r.doc_id in dict(data) and r.doc_id != 3:
            prints.setdefault(dict(data)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op3_fingerprints(spark, f"{tmp_path}/none").count() == 0


def test_fingerprint_likeness(spark):
    """Near the exact similarity for sets of all sizes, also where most bins are empty."""
    from lorewell.llm.fingerprints import add_fingerprint, likeness

    rng = random.Random(8)
    data, want = [], []
    for i in range(120):
        n = rng.choice([8, 20, 60, 400, 1500])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        cut = rng.randrange(n)
        b = a[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(n - cut)]
        data.append((i, " ".join(a), " ".join(b)))
        s, t = shingles(data[-1][1], 5), shingles(data[-1][2], 5)
        want.append(len(s & t) / len(s | t))
    df = spark.createDataFrame(data, "i int, a string, b string")
    df = add_fingerprint(add_fingerprint(df, "a", "fa"), "b", "fb")
    got = [r.x for r in df.select("i", likeness("fa", "fb").alias("x")).orderBy("i").collect()]
    err = np.array(got) - np.array(want)
    assert abs(err.mean()) < 0.02 and np.abs(err).max() < 0.2


def test_license_scan(spark, docs, empty):
    from lorewell.llm.license_scan import scan
    from lorewell.llm.license_templates import BASE, NOTICES

    rng = random.Random(9)
    fill = lambda k: " ".join(rng.choice(["the", "mit", "license", "cc", "by", "nc", "version", "2", "under", "apache"]) for _ in range(k))
    data = [(i, fill(60)) for i in range(60)] + [(100, "Under the MIT-License; CC BY NC cc by nc x"), (101, NOTICES[0][1].replace("free of charge", "at no charge")), (102, None), (103, ""), (103, ""), (None, "cc by nc")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {}
    for r in scan(df).collect():
        got.setdefault(r.id, []).append(r)
    for i, t in data:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
        at, labels = [], set()
        for label, p in BASE:
            p = p.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        r = got[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[101][0].labels == "mit" and got[101][0].n_base == 0 and 0.6 < got[101][0].score < 1
    assert len(got[103]) == 2
    assert scan(docs).count() == len(corpus()) and scan(empty).count() == 0


def test_piece_tokens(spark, docs, empty):
    import public_tokenizers

    from lorewell.llm.piece_tokens import decoded, encode_bpe, encode_texts, processor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = processor(path)
    got = rows(decoded(encode_bpe(docs, path), path), "doc_id", "n_pieces", "ids_crc32", "round_trip")
    want = []
    for i, t, _ in corpus():
        ids = sp.encode(t or "")
        want.append((i, len(ids), zlib.crc32(array("I", ids).tobytes()), sp.decode(ids) == (t or "")))
    assert got == sorted(want, key=repr)
    for t in HARD + ["a b  c d " * 30, " lead ▁x ▁ y" * 30]:
        assert encode_texts(sp, [t], 3) == [sp.encode(t)]
    assert encode_bpe(empty, path).count() == 0


def test_max_plus_scan(spark):
    """Chunks far smaller than pieces may straddle give a path of the best score over the whole text."""
    from lorewell.llm.piece_tokens import Unigram, encode_unigram

    rng = random.Random(1)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))): -rng.random() * 5 for _ in range(40)}
    pieces.pop("c", None)
    m = Unigram(pieces)
    data = [(i, "".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate([0, 1, 5, 17, 700])] + [(9, None)]
    out = encode_unigram(spark.createDataFrame(data, "doc_id long, text string"), m, chunk=7).orderBy("doc_id", "no").collect()
    names = {v: k for k, v in m.ids.items()}
    for i, t in data:
        ids = [x for r in out if r.doc_id == i for x in r.ids]
        want = m.path(t or "", 0, len(t or ""))
        score = lambda p: sum(m.scores[names[x]] if x else m.unknown for x in p)
        assert abs(score(ids) - score(want)) < 1e-6
        assert sum(len(names[x]) if x else 1 for x in ids) == len(t or "")
