"""Token-ID shards with a minimal perfect hash index (operator 10).

A shard file holds raw ids (16-bit where the vocabulary fits, else 32-bit) of documents in ascending key
order. Its index file maps a key to the place of its ids in constant time: a hash picks a bucket,
the bucket's stored pilot sends each of its keys to a slot of its own (as many slots as keys), and the slot
holds a 32-bit fingerprint of the key, offset, length and how many documents share the key. A
manifest table lists the shards with their first and last key and the ids before each.

Null keys sort first and count as one key; repeated keys keep all their documents, next to each other, ordered by
text, over as many shards as they need; null and empty texts give the end id alone; an empty table gives no shards. A
text of any length is encoded in runs and its ids are held once. Columns beside key and text are left out, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_value, one_each, ordered, shared_path, table
from .tokens import encoded, encoder

MAGIC = 0x31485044494B5401
_MAN = "shard long, path string, width int, n_docs long, n_tokens long, first_key long, last_key long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray, load: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Pilots and the slot of each of the distinct 64-bit keys: hash-and-displace, largest buckets first."""
    n = len(keys)
    m = max(1, int(n / load) + 1)
    bucket = (_mix(keys, 1) % np.uint64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=m)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    pilots, slots, taken = np.zeros(m, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    second = _mix(keys, 2)
    tries = np.arange(1 << 12, dtype=np.uint64)
    for b in np.argsort(-counts, kind="stable"):
        c = counts[b]
        if not c:
            break
        own = order[begin[b] : begin[b] + c]
        p = 0
        while True:
            at = place(second[own][None, :], (tries + np.uint64(p))[:, None], n)
            free = ~taken[at].any(axis=1)
            if c > 1:
                s = np.sort(at, axis=1)
                free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            hit = np.flatnonzero(free)
            if len(hit):
                pilots[b] = p + hit[0]
                slots[own] = at[hit[0]]
                taken[at[hit[0]]] = True
                break
            p += len(tries)
    return pilots, slots


def place(second: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    x = second ^ (pilot * np.uint64(0x9FB21C651E98DF25))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def find(keys: np.ndarray, index: dict) -> np.ndarray:
    """Slot of each key, or -1 where its fingerprint differs."""
    n, m = len(index["finger"]), len(index["pilots"])
    if not n:
        return np.full(len(keys), -1)
    k = keys.astype(np.uint64)
    pilot = index["pilots"][(_mix(k, 1) % np.uint64(m)).astype(np.int64)].astype(np.uint64)
    slot = place(_mix(k, 2), pilot, n)
    return np.where(index["finger"][slot] == (_mix(k, 3) >> np.uint64(32)).astype(np.uint32), slot, -1)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, parts, attempt: int) -> None:
    """Written under the attempt's own name, then renamed: a lost or doubled task leaves one whole file."""
    f, p = _open(uri)
    f.create_dir(p.rsplit("/", 1)[0], recursive=True)
    tmp = f"{p}.{attempt}.tmp"
    with f.open_output_stream(tmp) as out:
        for x in parts:
            out.write(x)
    _commit(f, tmp, p)


def _commit(f, tmp: str, path: str) -> None:
    try:
        f.move(tmp, path)
    except OSError:  # stores that don't rename onto a file that an earlier attempt left
        f.delete_file(path)
        f.move(tmp, path)


#: Stands for a null key, which no other key may be.
_NULL = -(1 << 63)


class _Shard:
    def __init__(self, root: str, shard: int, width: int, attempt: int):
        self.root, self.shard, self.width, self.attempt = root, shard, width, attempt
        self.f, p = _open(f"{root}/shard-{shard:015d}.bin")
        self.f.create_dir(p.rsplit("/", 1)[0], recursive=True)
        self.path, self.tmp = p, f"{p}.{attempt}.tmp"
        self.out = self.f.open_output_stream(self.tmp)
        self.keys: list[int] = []
        self.lens: list[int] = []
        self.total = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.keys.append(_NULL if key is None else key)
        self.lens.append(len(ids))
        self.total += len(ids)

    def close(self) -> tuple:
        self.out.close()
        _commit(self.f, self.tmp, self.path)
        keys, lens = np.array(self.keys, np.int64), np.array(self.lens, np.int64)
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        own, first, many = np.unique(keys, return_index=True, return_counts=True)
        pilots, slots = build_mph(own.astype(np.uint64))
        finger, offset, copies = np.empty(len(own), "<u4"), np.empty(len(own), "<u8"), np.empty(len(own), "<u4")
        finger[slots] = (_mix(own.astype(np.uint64), 3) >> np.uint64(32)).astype(np.uint32)
        offset[slots] = first
        copies[slots] = many
        head = np.array([MAGIC, self.width, len(own), len(pilots), len(keys)], "<u8")
        _put(f"{self.root}/shard-{self.shard:015d}.idx", [head.tobytes(), pilots.astype("<u4").tobytes(), finger.tobytes(), offset.tobytes(), copies.tobytes(), at.astype("<u8").tobytes(), lens.astype("<u8").tobytes(), keys.astype("<i8").tobytes()], self.attempt)
        return (self.shard, f"{self.root}/shard-{self.shard:015d}", self.width, len(keys), self.total, self.keys[0], self.keys[-1])


def read_index(path: str) -> dict:
    f, p = _open(f"{path}.idx")
    with f.open_input_stream(p) as s:
        raw = s.read()
    magic, width, n, m, d = (int(x) for x in np.frombuffer(raw, "<u8", 5))
    if magic != MAGIC:
        raise ValueError(f"{path}.idx is no index file")
    out, at = {"width": width}, 40
    for name, kind, count in (("pilots", "<u4", m), ("finger", "<u4", n), ("doc", "<u8", n), ("copies", "<u4", n), ("offset", "<u8", d), ("length", "<u8", d), ("key", "<i8", d)):
        out[name] = np.frombuffer(raw, kind, count, at)
        at += out[name].nbytes
    return out


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 27, shard_docs: int = 1 << 20) -> DataFrame:
    """Writes shards and indexes under `root` and returns the manifest, itself written there.

    One shuffle: documents are dealt by key range, so shards ascend with the partition number. Shards are
    closed at `shard_tokens` ids or `shard_docs` documents, which bounds the memory of an index.
    """

    def write(batches):
        width = 2 if encoder(tokenizer).size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        ctx, shard, k = TaskContext.get(), None, 0
        done = []
        for b in batches:
            ids = b.column(0).to_pylist()
            for key, e in zip(ids, encoded(b, "text", tokenizer, end_id)):
                if shard and (shard.total + len(e) > shard_tokens or len(shard.keys) >= shard_docs):
                    done.append(shard.close())
                    shard = None
                if shard is None:
                    shard, k = _Shard(root, (ctx.partitionId() << 24) + k, width, ctx.taskAttemptId()), k + 1
                shard.add(key, e)
        if shard:
            done.append(shard.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "path", "width", "n_docs", "n_tokens", "first_key", "last_key"])

    kv = key_value(docs, id_col, text_col)
    man = ordered(kv).mapInArrow(write, _MAN)
    man.write.parquet(f"{root}/manifest")
    man = docs.sparkSession.read.schema(man.schema).parquet(f"{root}/manifest")
    # One row a shard: a few bytes for each 2**27 ids.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return man.withColumn("start", before)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents from the files: doc_id, start, n_tokens, ids_crc32 and whether the index finds the key at that place."""

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ix = read_index(path)
                slot = find(ix["key"].view(np.uint64), ix)
                head = ix["doc"][np.maximum(slot, 0)].astype(np.int64)
                rank = np.arange(len(slot)) - head
                ok = (slot >= 0) & (rank >= 0) & (rank < ix["copies"][np.maximum(slot, 0)])
                crc = np.empty(len(slot), np.int64)
                f, p = _open(f"{path}.bin")
                kind = np.dtype("<u2" if ix["width"] == 2 else "<u4")
                with f.open_input_stream(p, buffer_size=1 << 20) as s:
                    for i, n in enumerate(ix["length"]):
                        ids = np.frombuffer(s.read(int(n) * kind.itemsize), kind)
                        if len(ids) != n:
                            raise OSError(f"{path}.bin is shorter than its index says")
                        crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
                null = ix["key"] == _NULL
                yield pa.RecordBatch.from_arrays([pa.array(ix["key"], mask=null), pa.array(ix["offset"].astype(np.int64) + start), pa.array(ix["length"].astype(np.int64)), pa.array(crc), pa.array(ok)], names=["doc_id", "start", "n_tokens", "ids_crc32", "in_index"])

    return one_each(manifest.select("path", "start"), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, in_index boolean")


class TokenReader:
    """Keyed access to written shards: a manifest lookup, one index probe and one ranged read. `most` indexes stay in memory."""

    def __init__(self, manifest: DataFrame, most: int = 64):
        self.most = most
        self.shards = sorted((r.first_key, r.last_key, r.path) for r in manifest.select("first_key", "last_key", "path").toLocalIterator())
        self.firsts = [s[0] for s in self.shards]
        self._index: dict[str, dict] = {}

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document of that key; none where no document has it."""
        k, out = _NULL if key is None else key, []
        i = bisect.bisect_right(self.firsts, k) - 1
        while i >= 0 and self.shards[i][1] >= k:
            path = self.shards[i][2]
            if path not in self._index:
                if len(self._index) >= self.most:
                    self._index.pop(next(iter(self._index)))
                self._index[path] = read_index(path)
            ix = self._index[path]
            slot = int(find(np.array([k], np.int64).view(np.uint64), ix)[0])
            if slot >= 0 and ix["key"][ix["doc"][slot]] == k:
                d, c = int(ix["doc"][slot]), int(ix["copies"][slot])
                f, p = _open(f"{path}.bin")
                with f.open_input_file(p) as s:
                    for j in range(d, d + c):
                        s.seek(int(ix["offset"][j]) * ix["width"])
                        out.append(np.frombuffer(s.read(int(ix["length"][j]) * ix["width"]), "<u2" if ix["width"] == 2 else "<u4").astype(np.uint32))
            i -= 1
        return out


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    man = write_tokens(table(spark, sf_dir, "documents"), shared_path(spark, "token-ids"), public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(man)


QUERIES = {"op10_token_output": op10_token_output}
