"""Order-preserving packing of tokenised documents into fixed windows (operator 4).

Documents are taken in ascending key order within ranges of keys, and packed in runs of about `flush` ids. Over a run's ids, cut
points are the ends of documents, the ends of sentences (a token that ends in . ! ? or a line break) and, where
those lie more than `reach` ids apart, evenly spaced points in between. The least sum of padding and cut penalties is
found by dynamic programming: f(j) = penalty(j) + width - p(j) + min over p(i) >= p(j) - width of f(i) + p(i), where a
monotone queue gives the minimum in constant amortised time. A sequence whose length is a power of two is not padded; the
transition looks for those of at least a quarter of the width, and a run's rest may be cut into powers of two.

Null and empty texts are the end id alone. Null keys come first; repeated keys are ordered by
text, and spread over tasks like others. An empty table gives no rows. Every id is in exactly one piece. A very long text is
one document: its ids are held once, and of cuts that cost the same the earliest queue entry is taken. Columns beside key
and text are left out, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import key_value, ordered, table
from .tokens import encoded, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(points: list[int], penalty: list[int], width: int, hard: int) -> list[int]:
    """Ends of the sequences over ids 0..points[-1]: points and, in the last sequence, powers of two.

    points ascend in steps of at most `width`; penalty[j] is that of cutting at points[j].
    """
    pos = [0, *points]
    at = np.array(pos)
    # Earlier points at a power of two; few, so they stand in a dict.
    near: dict[int, list[int]] = {}
    for s in (1 << k for k in range(max(width.bit_length() - 3, 0), width.bit_length()) if 1 << k < width):
        i = np.searchsorted(at, at - s)
        for j in np.flatnonzero(at[i] == at - s).tolist():
            near.setdefault(j, []).append(int(i[j]))
    # key(j) = f(j) + p(j), so key(j) = penalty(j) + width + the window's least key.
    key, back, queue, head = [0], [0], [0], 0
    for j, (p, fine) in enumerate(zip(points, penalty), 1):
        low = p - width
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        k = key[i] + width + fine
        if j in near:
            for t in near[j]:
                c = key[t] - pos[t] + p + fine
                if c < k:
                    k, i = c, t
        key.append(k)
        back.append(i)
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    total = pos[-1]

    def rest(n: int) -> int:
        return min(width - n, hard * (n.bit_count() - 1))

    first = len(pos) - 2
    while first > 0 and pos[first - 1] >= total - width:
        first -= 1
    last = min((i for i in range(first, len(pos) - 1) if total - pos[i] <= width), key=lambda i: (key[i] - pos[i] + rest(total - pos[i]), -i))
    n, ends = total - pos[last], [total]
    if width - n > hard * (n.bit_count() - 1):
        while n & (n - 1):
            n -= n & -n
            ends.append(pos[last] + n)
    j = last
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def sentence_ends(tokenizer: str) -> np.ndarray:
    """For each id, whether its string ends in . ! ? or a line break (C with dot above: the byte-level line feed)."""
    enc = encoder(tokenizer)
    out = np.zeros(enc.size, bool)
    for s, i in enc.tok.get_vocab(with_added_tokens=True).items():
        out[i] = s.removesuffix("</w>").endswith((".", "!", "?", "\n", "Ċ"))
    return out


class Packer:
    def __init__(self, part: int, tokenizer: str, width: int, sentence: int, hard: int, reach: int, flush: int):
        self.part = part
        self.width, self.sentence, self.hard, self.reach, self.flush = width, sentence, hard, reach, flush
        self.tokenizer, self.ends = tokenizer, sentence_ends(tokenizer)
        self.local = 0
        self.keys: list = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, key, ids: np.ndarray):
        """A document; gives a batch when those before it are packed, once `flush` ids wait."""
        if self.size >= self.flush:
            yield self.pack()
        self.keys.append(key)
        self.ids.append(ids)
        self.size += len(ids)

    def pack(self) -> pa.RecordBatch:
        lens = np.array([len(x) for x in self.ids], np.int64)
        ids = np.concatenate(self.ids)
        doc_end = np.cumsum(lens)
        penalty = np.zeros(len(ids) + 1, np.int64)
        penalty[1:][self.ends[np.minimum(ids, len(self.ends) - 1)]] = self.sentence
        is_cut = penalty > 0
        is_cut[doc_end] = True
        penalty[doc_end] = 0
        points = np.flatnonzero(is_cut)
        gaps = np.diff(points, prepend=0)
        far = np.flatnonzero(gaps > self.reach)
        if len(far):
            extra = np.concatenate([np.arange(points[k] - gaps[k] + self.reach, points[k], self.reach) for k in far])
            penalty[extra] = self.hard
            points = np.union1d(points, extra)
        ends = np.array(cut(points.tolist(), penalty[points].tolist(), self.width, self.hard), np.int64)
        seq_start = np.concatenate(([0], ends[:-1]))
        doc_start = doc_end - lens
        starts = np.union1d(seq_start, doc_start)
        length = np.diff(starts, append=len(ids))
        seq = np.searchsorted(seq_start, starts, "right") - 1
        doc = np.searchsorted(doc_start, starts, "right") - 1
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), length.tolist())), np.int64, len(starts))
        keys = pa.array(self.keys, pa.int64()).take(pa.array(doc))
        out = pa.RecordBatch.from_arrays([keys, pa.array(starts - doc_start[doc]), pa.array(length), pa.array(crc), pa.array(lens[doc]), pa.array(self.part * (1 << 40) + self.local + seq), pa.array(starts - seq_start[seq])], names=[x.split()[0] for x in SCHEMA.split(", ")])
        self.local += len(ends)
        self.keys, self.ids, self.size = [], [], 0
        return out


def pack(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", sentence: int = 1, hard: int = 6, reach: int = 32, flush: int = 1 << 20) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The texts are shuffled once, by ranges of keys. A task holds one run of at most `flush` ids and a document. Sequence ids
    ascend with the key.
    """
    end = -1 if end_id is None else end_id

    def run(batches):
        p = Packer(TaskContext.get().partitionId(), tokenizer, width, sentence, hard, reach, flush)
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), encoded(b, "text", tokenizer, None if end < 0 else end)):
                if len(ids):
                    yield from p.add(key, ids)
        if p.keys:
            yield p.pack()

    return ordered(key_value(docs, id_col, text_col)).mapInArrow(run, SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op4_packing": op4_packing}
