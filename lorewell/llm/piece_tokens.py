"""SentencePiece encoding and decoding (operator 7): best-scoring segmentation, giant documents by a max-plus parallel scan.

The pieces' scores make the sum of a segmentation; the best one is found. Spaces stand for U+2581, and one stands before every
text that isn't empty. No piece goes on after a space that follows another character, so every text falls into units (spaces, then other
characters) whose best paths follow each other; equal units are solved once and looked up as arrays. Where scores are
whole numbers, equal sums are told apart by a small weight for each id; what may still depend on how a text is cut is the order of
equal pieces, as in a long run of one letter, inside a unit that a chunk's edge cuts.

A giant document is split into chunks of characters. A piece can straddle a chunk's edge, so the state at an
edge is how many characters beyond it the straddling piece reaches (0 up to the longest piece less one). Each chunk yields
the max-plus matrix of the best sum from each entry state to each exit state; matrices combine associatively, level by level
in groups of `FAN`; walking down again fixes every edge's state; then each chunk is backtraced on its own. The ids of
a chunk are joined to those before it as a stream, so no task holds a giant document twice.

The public model was trained as BPE, whose library merges greedily by rank: `encode_bpe` gives the library's ids, with giant
texts cut where no merge can cross. The query's ids are those of the best path.

Null and empty texts have no pieces. Repeated keys are encoded row by row. Characters that no piece covers become their bytes.
Columns beside key and text are left out, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from array import array
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, key_value, table, written
from .textbytes import _TABLE, BASE, BASE_INV, buffer, mix, powers, slices
from .tokens import _Table

FAN = 64
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_models: dict = {}


def processor(model_file: str):
    """One processor a process and file."""
    if model_file not in _models:
        import sentencepiece

        _models[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return _models[model_file]


def parts(text: str, most: int) -> list[str]:
    """The text cut at merge-free spaces into parts of about `most` characters; the space of each cut is dropped."""
    out, at = [], 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def encode_texts(sp, texts: list[str], most: int = 1 << 14) -> list[list[int]]:
    split = [parts(t, most) for t in texts]
    flat = sp.encode([p for ps in split for p in ps], num_threads=1)
    out, at = [], 0
    for ps in split:
        out.append([i for ids in flat[at : at + len(ps)] for i in ids] if len(ps) > 1 else flat[at])
        at += len(ps)
    return out


def encode_bpe(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (raw unsigned 32-bit), text: in place, without a shuffle."""

    def run(batches):
        from .tokens import groups

        sp = processor(model_file)
        for b in batches:
            at = 0
            for run_ in groups(b.column(1).to_pylist()):
                ids = [array("I", x).tobytes() for x in encode_texts(sp, run_)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run_)), pa.array(ids, pa.binary()), b.column(1).slice(at, len(run_))], names=["doc_id", "ids", "text"])
                at += len(run_)

    return key_value(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, text string")


_FACTS = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def decoded(encoded: DataFrame, model_file: str) -> DataFrame:
    """Facts of each encoded row (doc_id, ids, text): n_pieces, ids_crc32, sha256 of the decoded text, whether it is the text again."""

    def run(batches):
        m = loaded(model_file)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield _facts(m, b.column(0), [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()], b.column(2))

    return encoded.mapInArrow(run, _FACTS)


def _facts(m: Unigram, keys: pa.Array, ids: list[np.ndarray], texts: pa.Array) -> pa.RecordBatch:
    crc, sums, same = [], [], []
    for x, t in zip(ids, texts):
        got = m.decode(x).removeprefix(b" ")
        crc.append(zlib.crc32(x.astype("<u4").tobytes()))
        sums.append(sha256(got).hexdigest())
        same.append(got == t.as_buffer().to_pybytes())
    cols = [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(sums, pa.string()), pa.array(same, pa.bool_())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _FACTS.split(", ")])


NONE = -(1 << 61)
_NULL = -(1 << 63)
#: Units of more bytes are solved one by one.
WIDEST = 64
_SPACES = np.zeros(256, bool)
_SPACES[32] = True


class Unigram:
    """Best-scoring segmentation by pieces' scores; a character that begins no piece costs `unknown` and is id 0, or its bytes' ids.

    Weights are whole numbers, so that sums are exact in any order.
    """

    def __init__(self, scores: dict[str, float], unknown: float | None = None, ids: dict[str, int] | None = None, byte_ids: list[int] | None = None):
        self.ids = ids or {p: i for i, p in enumerate(scores, 1)}
        self.scores, self.byte_ids = scores, byte_ids
        self.longest = max(map(len, scores), default=1)
        used = [x for x in scores.values() if x > -1e8]  # below: pieces that are never the best
        self.unknown = min(used, default=0) - 10 if unknown is None else unknown
        whole = all(float(x).is_integer() for x in [*scores.values(), self.unknown])
        unit = (1 << 24) if whole else (1 << 32)
        self.weights = {p: round(max(x, -1e6) * unit) + (self.ids[p] * 40503 % 65536 if whole else 0) for p, x in scores.items()}
        self.unknown_weight = round(self.unknown * unit)
        self.reach: dict[str, int] = {}
        for p in scores:
            self.reach[p[0]] = max(self.reach.get(p[0], 1), len(p))
        self.units, self._known = _Table(18), None

    @classmethod
    def load(cls, model_file: str) -> Unigram:
        sp = processor(model_file)
        n = sp.vocab_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        first = next((i for i in range(n) if sp.is_byte(i)), None)
        names = {sp.id_to_piece(i).replace("\u2581", " "): i for i in plain}
        m = cls({p: sp.get_score(i) for p, i in names.items()}, ids=names, byte_ids=None if first is None else list(range(first, first + 256)))
        m.pieces = [b""] * n
        for p, i in names.items():
            m.pieces[i] = p.encode()
        for b, i in enumerate(m.byte_ids or []):
            m.pieces[i] = bytes([b])
        return m

    def matches(self, text: str, at: int):
        """(length, weight) of the pieces that begin at a place; always one of length 1."""
        one = False
        for n in range(1, min(self.reach.get(text[at], 0), len(text) - at) + 1):
            w = self.weights.get(text[at : at + n])
            if w is not None:
                one |= n == 1
                yield n, w
        if not one:
            yield 1, self.unknown_weight

    def back(self, text: str) -> list[int]:
        """Best sum from each place to the end."""
        best = [NONE] * len(text) + [0]
        for at in range(len(text) - 1, -1, -1):
            best[at] = max(w + best[at + n] for n, w in self.matches(text, at))
        return best

    def forward(self, text: str, n: int) -> tuple[list[int], list[int]]:
        """Best sum to each place from the start by pieces that begin before n, and the last piece's start."""
        best, last = [0] + [NONE] * len(text), [0] * (len(text) + 1)
        for at in range(n):
            b = best[at]
            if b > NONE:
                for size, w in self.matches(text, at):
                    if b + w > best[at + size]:
                        best[at + size], last[at + size] = b + w, at
        return best, last

    def path(self, text: str, begin: int, end: int) -> list[int]:
        """Ids of the best path from place begin to place end."""
        text = text[begin:end]
        _, last = self.forward(text, len(text))
        out, at = [], len(text)
        while at:
            piece = text[last[at] : at]
            i = self.ids.get(piece)
            out += [i] if i is not None else [self.byte_ids[b] for b in reversed(piece.encode())] if self.byte_ids else [0]
            at = last[at]
        return out[::-1]

    def total(self, text: str) -> int:
        """Sum of the best path."""
        return self.forward(text, len(text))[0][-1]

    def transfer(self, text: str, n: int) -> np.ndarray:
        """Max-plus matrix of a chunk: text[:n] and up to longest - 1 characters after it.

        Between the first and the last unit that begin in the chunk there is one best sum; only what lies before
        and after depends on the states.
        """
        k = self.longest
        cuts = [i for i in _unit_starts(text[:n]) if i]
        out = np.full((k, k), NONE, np.int64)
        if not cuts:
            for s in range(min(k, n)):
                best, _ = self.forward(text[s:], n - s)
                ends = best[n - s : n - s + k]
                out[s, : len(ends)] = ends
            for s in range(n, k):  # the piece that came in reaches beyond this chunk
                out[s, s - n] = 0
            return out
        before = self.back(text[: cuts[0]])
        ends = self.forward(text[cuts[-1] :], n - cuts[-1])[0][n - cuts[-1] :][:k]
        known: dict[str, int] = {}
        mid = 0
        for a, z in zip(cuts, cuts[1:]):
            u = text[a:z]
            if u not in known:
                known[u] = self.total(u)
            mid += known[u]
        entry = np.full(k, NONE, np.int64)
        entry[: min(k, len(before))] = before[:k]
        exit_ = np.full(k, NONE, np.int64)
        exit_[: len(ends)] = ends
        out = entry[:, None] + exit_[None, :]
        out[(entry[:, None] <= NONE) | (exit_[None, :] <= NONE)] = NONE
        out[out > NONE] += mid
        return out

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow string column, whose spaces stand for U+2581, without a leading space of its own."""
        raw, off = buffer(col)
        n = len(off) - 1
        space = _SPACES[raw]
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(first)
        stop = np.append(start[1:], len(raw))
        bounds = np.searchsorted(start, off)
        if not len(start):
            return [np.zeros(0, np.uint32)] * n
        pre = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * powers(BASE, len(raw)), out=pre[1:])
        h = _span(pre, start, stop)
        size = np.minimum(stop - start, 8).astype(np.uint64)
        pad = np.concatenate((raw, np.zeros(8, np.uint8)))
        head = np.ndarray((len(raw) + 1,), "<u8", pad.data, 0, (1,))[start] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * size))
        if self.units.count > 1 << 20:
            self.units = _Table(18)
        t = self.units
        slot = t.find(h, head)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, one = np.unique(h[miss] ^ (head[miss] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            new = miss[one]
            t.add(h[new], head[new], self.solve(raw, pre, start[new], stop[new]))
            slot = t.find(h, head)  # the table may have grown
        sizes = t.size[slot].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = t.pool[np.repeat(t.begin[slot] - ends[:-1], sizes) + np.arange(ends[-1])]
        return [ids[a:z] for a, z in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())]

    def _prefixes(self) -> tuple[_Table, np.ndarray, np.ndarray, int]:
        """Hashes of all pieces' beginnings, by bytes, with the weight and id of those that are pieces."""
        if self._known is None:
            pieces = [p.encode() for p in self.weights]
            raw, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
            begin = np.cumsum(size) - size
            pre = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_TABLE[raw] * powers(BASE, len(raw)), out=pre[1:])
            steps = np.arange(len(raw)) - np.repeat(begin, size) + 1
            h = np.unique(_span(pre, np.repeat(begin, size), np.repeat(begin, size) + steps))
            t = _Table((4 * len(h)).bit_length())
            t.add(h, np.zeros(len(h), np.uint64), [b""] * len(h))
            slot = t.find(_span(pre, begin, begin + size), np.zeros(len(pieces), np.uint64))
            weight, own = np.full(len(t.hash), NONE, np.int64), np.zeros(len(t.hash), np.uint32)
            weight[slot], own[slot] = list(self.weights.values()), [self.ids[p] for p in self.weights]
            self._known = t, weight, own, int(size.max(initial=1))
        return self._known

    def solve(self, raw: np.ndarray, pre: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """Ids of the best path of each unit raw[start:stop], all units at once; long ones and those with unknown characters by path()."""
        table, weight, own, most = self._prefixes()
        size, n = stop - start, len(start)
        slow = size > WIDEST
        unit = np.repeat(np.flatnonzero(~slow), size[~slow])
        at = np.arange(len(unit)) - np.repeat(np.cumsum(size[~slow]) - size[~slow], size[~slow])
        lead = (raw & 0xC0) != 0x80
        keep = lead[start[unit] + at]
        unit, at = unit[keep], at[keep]
        width = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 3, 4])[raw[start[unit] + at] >> 4]
        single = np.zeros(len(unit), bool)
        found, live = [], np.arange(len(unit))
        for step in range(1, most + 1):
            live = live[at[live] + step <= size[unit[live]]]
            if not len(live):
                break
            a = start[unit[live]] + at[live]
            slot = table.find(_span(pre, a, a + step), np.zeros(len(live), np.uint64))
            live, slot = live[slot >= 0], slot[slot >= 0]
            is_piece = weight[slot] > NONE
            single[live[is_piece & (width[live] == step)]] = True
            hit, slot = live[is_piece], slot[is_piece]
            found.append((unit[hit], at[hit], np.full(len(hit), step), weight[slot], own[slot]))
        slow[unit[~single]] = True
        best = np.full((n, WIDEST + 1), NONE, np.int64)
        best[:, 0] = 0
        last, who = np.zeros((n, WIDEST + 1), np.int16), np.zeros((n, WIDEST + 1), np.uint32)
        if found:
            u, b, step, w, i = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((step, b))
            u, b, step, w, i = u[order], b[order], step[order], w[order], i[order]
            edges = np.flatnonzero(np.diff(b * 256 + step, prepend=-1, append=-1))
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):  # one start and length at a time: each unit at most once
                r, p, q = u[x:y], int(b[x]), int(b[x] + step[x])
                value = best[r, p] + w[x:y]
                up = value > best[r, q]
                r = r[up]
                best[r, q], last[r, q], who[r, q] = value[up], p, i[x:y][up]
        place = np.where(slow, 0, size)
        path: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(place > 0)
        while len(live):
            path.append((live, who[live, place[live]]))
            place[live] = last[live, place[live]]
            live = live[place[live] > 0]
        rows = np.concatenate([r for r, _ in path[::-1]]) if path else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in path[::-1]]) if path else np.zeros(0, np.uint32)
        order = np.argsort(rows, kind="stable")
        flat = memoryview(ids[order].astype(np.uint32).tobytes())
        ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))) * 4
        out = [bytes(flat[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for k in np.flatnonzero(slow).tolist():
            text = raw[start[k] : stop[k]].tobytes().decode()
            out[k] = array("I", self.path(text, 0, len(text))).tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The pieces' bytes; a model from load()."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_loaded: dict[str, Unigram] = {}


def loaded(model_file: str) -> Unigram:
    """One model a process and file."""
    if model_file not in _loaded:
        _loaded[model_file] = Unigram.load(model_file)
    return _loaded[model_file]


def _span(pre: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hash of bytes a to z, never 0, from their prefix sums."""
    h = (pre[z] - pre[a]) * powers(BASE_INV, len(pre))[a]
    return mix(h + (z - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _unit_starts(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c == " " and (i == 0 or text[i - 1] != " ")]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def states(mats: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """States at all edges of consecutive chunks on a best path from entry to exit."""
    k = len(mats[0])
    front = [np.where(np.arange(k) == entry, 0, NONE)]
    for m in mats:
        front.append(np.maximum((front[-1][:, None] + m).max(axis=0), NONE))
    out = [exit_]
    for v, m in zip(front[-2::-1], mats[::-1]):
        out.append(int(np.argmax(v + m[:, out[-1]])))
    return out[::-1]


def encode_unigram(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 14) -> DataFrame:
    """(doc_id, th, no, ids): the ids of each chunk of each distinct document (key and text hash), in order of `no`, by the parallel scan.

    `model` is a Unigram or a file that workers load. Spaces stand for U+2581; none is put before a text. A null key is
    -2**63 here. Chunks are cut in one pass over a text.
    """
    spark = docs.sparkSession
    get = (lambda: loaded(model)) if isinstance(model, str) else (lambda: model)
    k = get().longest
    kv = key_value(docs, id_col, text_col).filter("text <> ''").select(F.coalesce("id", F.lit(_NULL)).alias("id"), F.xxhash64("text").alias("th"), "text")

    def cut(batches):
        for b in batches:
            for i, th, t in zip(*(c.to_pylist() for c in b.columns)):
                for no, at in enumerate(range(0, len(t), chunk)):
                    piece = t[at : at + chunk + k - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([th], pa.int64()), pa.array([no], pa.int64()), pa.array([piece], pa.string()), pa.array([min(chunk, len(t) - at)], pa.int32())], names=["id", "th", "no", "text", "size"])

    rows, rows_at = written(kv.mapInArrow(cut, "id long, th long, no long, text string, size int").dropDuplicates(["id", "th", "no"]), "scan-chunks")
    kind = "id long, th long, no long, m binary"

    def mats(batches):
        for b in batches:
            m = [get().transfer(t, n).tobytes() for t, n in zip(b.column("text").to_pylist(), b.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), b.column("no"), pa.array(m, pa.binary())], names=["id", "th", "no", "m"])

    levels = [written(rows.mapInArrow(mats, kind), "scan-matrices")]

    def up(key, p):
        p = p.sort_values("no")
        m = None
        for x in p.m:
            x = np.frombuffer(x, np.int64).reshape(k, k)
            m = x if m is None else product(m, x)
        return pd.DataFrame({"id": [key[0]], "th": [key[1]], "no": [key[2]], "m": [m.tobytes()]})

    while levels[-1][0].filter("no > 0").limit(1).count():
        block = levels[-1][0].groupBy("id", "th", F.floor(F.col("no") / FAN).alias("block"))
        levels.append(written(block.applyInPandas(up, kind), "scan-matrices"))
    found, found_at = levels[-1][0].select("id", "th", "no", F.lit(0).alias("s_in"), F.lit(0).alias("s_out")), []

    def down(key, p):
        p = p.sort_values("no")
        s = states([np.frombuffer(x, np.int64).reshape(k, k) for x in p.m], int(p.s_in.iloc[0]), int(p.s_out.iloc[0]))
        return pd.DataFrame({"id": p.id, "th": p.th, "no": p.no, "s_in": s[:-1], "s_out": s[1:]})

    for level, _ in levels[-2::-1]:
        above = found.withColumnRenamed("no", "block")
        own = level.withColumn("block", F.floor(F.col("no") / FAN)).join(above, ["id", "th", "block"])
        found, at = written(own.groupBy("id", "th", "block").applyInPandas(down, "id long, th long, no long, s_in int, s_out int"), "scan-states")
        found_at.append(at)

    def trace(batches):
        for b in batches:
            m = get()
            texts = [t[a : n + z] for t, n, a, z in zip(*(b.column(c).to_pylist() for c in ("text", "size", "s_in", "s_out")))]
            ids = pa.array([x.tolist() for x in m.encode(pa.array(texts, pa.string()))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), b.column("no"), ids], names=["doc_id", "th", "no", "ids"])

    out, _ = written(rows.join(found, ["id", "th", "no"]).mapInArrow(trace, "doc_id long, th long, no long, ids array<long>"), "scan-ids")
    drop(spark, rows_at, *[at for _, at in levels], *found_at)
    return out


def _streamed(batches, model_file: str):
    """Facts of each document from its chunks in order: running sums, so only one chunk is held."""
    m, now, n = loaded(model_file), None, 0
    crc, sha = 0, sha256()

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, n, crc, sha.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["id", "th", "n_pieces", "ids_crc32", "decoded_sha256"])

    for b in batches:
        for i, th, ids in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("ids")):
            ids = np.asarray(ids.values).astype(np.uint32)
            text = m.decode(ids)
            if (i, th) != now:
                if now:
                    yield row()
                now, n, crc, sha = (i, th), 0, 0, sha256()
                text = text.removeprefix(b" ")
            n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
            sha.update(text)
    if now:
        yield row()


def best_path(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", giant: int = 1 << 16, chunk: int = 1 << 14) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, round_trip of each row by the best path; texts over `giant` characters by the scan."""
    kv = key_value(docs, id_col, text_col).withColumn("spaced", F.when(F.col("text") == "", F.col("text")).otherwise(F.concat(F.lit(" "), F.translate("text", "\u2581", " "))))

    def run(batches):
        m = loaded(model_file)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield _facts(m, b.column(0), m.encode(b.column(2)), b.column(1))

    large = F.char_length("text") > giant
    small = kv.filter(~large).mapInArrow(run, _FACTS)
    big = kv.filter(large).withColumn("th", F.xxhash64("spaced"))
    ids = encode_unigram(big.select("id", "spaced"), model_file, "id", "spaced", chunk)
    facts = ids.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "no").mapInArrow(lambda it: _streamed(it, model_file), "id long, th long, n_pieces long, ids_crc32 long, decoded_sha256 string")
    names = big.select(F.col("id").alias("doc_id"), F.coalesce("id", F.lit(_NULL)).alias("id"), "th", F.sha2("text", 256).alias("own"))
    whole = names.join(facts, ["id", "th"]).select("doc_id", "n_pieces", "ids_crc32", "decoded_sha256", (F.col("own") == F.col("decoded_sha256")).alias("round_trip"))
    return small.unionByName(whole)


def op7_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_path(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op7_piece_tokens": op7_piece_tokens}
