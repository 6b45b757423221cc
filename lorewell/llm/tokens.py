"""Token ids of whole texts by the tokenizers library, with a cache of words.

Both kinds of pre-tokenizer that the public files use never join what stands left and right of a single
space or line break between two characters that are no white space: a token ends before it, or it is a token (or
nothing) of its own, or a space begins the next token. A text is therefore cut there, each distinct part
is encoded once by the library, and the ids are joined. A part of letters and then ASCII punctuation is two pre-tokens and
its letters are kept as one word. White-space runs stay inside their part and the library sees them whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_UNSAFE = re.compile(r"[ \n]\s|\s[ \n]")
#: ASCII punctuation without the apostrophe, which may begin a contraction.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_encoders: dict[tuple, "Encoder"] = {}


class Encoder:
    #: Cached parts and words, and the longest that is kept; both only bound memory.
    MOST, LONGEST = 700_000, 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _each(self, parts: list[str]) -> list[bytes]:
        # The library's results are large, so few parts go in at once.
        runs = (parts[i : i + 4096] for i in range(0, len(parts), 4096))
        return [array("I", e.ids).tobytes() for r in runs for e in self.tok.encode_batch(r, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters after a space; many words go through the library as one text of lines."""
        out: list[bytes] = []
        runs = [words[i : i + 512] for i in range(0, len(words), 512)]
        encodings = (e for i in range(0, len(runs), 16) for e in self.tok.encode_batch([" " + "\n ".join(r) for r in runs[i : i + 16]], add_special_tokens=False))
        for run, e in zip(runs, encodings):
            of = np.array(e.word_ids)
            raw = np.array(e.ids, np.uint32).tobytes()
            at = np.flatnonzero(of[1:] != of[:-1]) + 1
            if len(at) + 1 not in (len(run), 2 * len(run) - 1):
                out += self._each([" " + w for w in run])  # a word that the normaliser breaks up
                continue
            at = [0, *(4 * at).tolist(), len(raw)]
            step = 1 if len(at) - 1 == len(run) else 2
            out += [raw[at[i] : at[i + 1]] for i in range(0, len(at) - 1, step)]
        return out

    def _fill(self, parts: set[str]) -> None:
        """Parts that follow a space (or begin with a line break) into the cache."""
        words, first, cores, heads, odd = self.words, self.first, {}, {}, []
        bare = []
        for p in parts:
            if p.isalpha():
                bare.append(p)
                continue
            q = p[1:] if p[0] == "\n" else p
            core = q.rstrip(_SIGNS)
            if core.isalpha():
                (heads if q is not p else cores)[p] = (core, q[len(core) :])
            else:
                odd.append(p)
        rest = self.rest
        odds = zip(odd, self._each([p if p[0] == "\n" else " " + p for p in odd]))
        rest.update(odds)
        new = list({c for c, _ in cores.values()}.union(bare).difference(words))
        words.update(zip(new, self._spaced(new)))
        rest.update(zip(bare, map(words.__getitem__, bare)))
        new = list({x for pair in (*heads.values(), *((s,) for _, s in cores.values()), "\n") for x in pair if x}.difference(first))
        first.update(zip(new, self._each(new)))
        for p, (c, s) in cores.items():
            rest[p] = words[c] + first[s]
        for p, (c, s) in heads.items():
            rest[p] = first["\n"] + first[c] + (first[s] if s else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers, little-endian on every machine that Spark runs on."""
        for c in (self.first, self.rest, self.words):
            if len(c) > self.MOST:
                c.clear()
        split = []
        for t in texts:
            bad = t[:1].isspace() or t[-1:].isspace() or _UNSAFE.search(t)
            split.append(_SAFE.split(t) if bad else t.replace("\n", " \n").split(" "))
        heads = list({p[0] for p in split}.difference(self.first))
        self.first.update(zip(heads, self._each(heads)))
        first, rest = self.first, self.rest.__getitem__
        lead = [first[p.pop(0)] for p in split]
        tails = set().union(*split).difference(self.rest)
        self._fill(tails)
        out = [a + b"".join(map(rest, p)) for a, p in zip(lead, split)]
        for c, new in ((self.first, heads), (self.rest, tails), (self.words, tails)):
            for p in new:
                if len(p) > self.LONGEST:
                    c.pop(p, None)
        return out


_SEPS = np.zeros(256, bool)
_SEPS[[10, 32]] = True
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in _SIGNS]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_KINDS = np.array([0x0, 0x9E6C63D0876A9A47, 0x3C79AC492BA7B653], np.uint64)


class _Table:
    """Open-addressing table in arrays: word hash, first bytes, where its ids begin in the pool and how many they are."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.hash, self.head = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 20, np.uint32), 0, 0

    def find(self, h: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 where it isn't there."""
        out, todo = np.full(len(h), -1), np.arange(len(h))
        at = (h & self.mask).astype(np.int64)
        while len(todo):
            have = self.hash[at]
            hit = (have == h[todo]) & (self.head[at] == head[todo])
            out[todo[hit]] = at[hit]
            on = ~hit & (have != 0)
            todo, at = todo[on], (at[on] + 1) & int(self.mask)
        return out

    def add(self, h: np.ndarray, head: np.ndarray, ids: list[bytes]) -> None:
        """Distinct new words; the table grows so that at least half of its slots stay free."""
        if 2 * (self.count + len(h)) > len(self.hash):
            self._grow(self.count + len(h))
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)))
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.used, self.count = self.used + len(flat), self.count + len(h)
        self._place(h, head, begin, sizes)

    def _grow(self, words: int) -> None:
        old = np.flatnonzero(self.hash)
        rows = self.hash[old], self.head[old], self.begin[old], self.size[old]
        bits = (2 * words - 1).bit_length()
        self.mask = np.uint64((1 << bits) - 1)
        self.hash, self.head = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.begin, self.size = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self._place(*rows)

    def _place(self, h: np.ndarray, head: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        todo, at = np.arange(len(h)), (h & self.mask).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.hash[at] == 0)
            self.hash[at[free]] = h[todo[free]]
            self.head[at[free]] = head[todo[free]]
            mine = (self.hash[at] == h[todo]) & (self.head[at] == head[todo])
            self.begin[at[mine]], self.size[at[mine]] = begin[todo[mine]], sizes[todo[mine]]
            todo, at = todo[~mine], (at[~mine] + 1) & int(self.mask)


class ColumnEncoder(Encoder):
    """The same ids for whole Arrow columns: words are found in the raw bytes and looked up as arrays; only new ones are strings."""

    def __init__(self, path: str):
        super().__init__(path)
        self.table = _Table()
        self.line = array("I", self.tok.encode("\n", add_special_tokens=False).ids).tobytes()

    def _new(self, words: list[str], kinds: list[int]) -> list[bytes]:
        """Ids of new words: 0 as they are, 1 after a space, 2 after a line break."""
        out: list[bytes] = [b""] * len(words)
        spaced = [i for i, (w, k) in enumerate(zip(words, kinds)) if k == 1 and w.isalpha()]
        for i, b in zip(spaced, self._spaced([words[i] for i in spaced])):
            out[i] = b
        rest = [i for i, b in enumerate(out) if not b and not (kinds[i] == 1 and words[i].isalpha())]
        for i, b in zip(rest, self._each([" " + words[i] if kinds[i] == 1 else words[i] for i in rest])):
            out[i] = self.line + b if kinds[i] == 2 else b
        return out

    def column(self, raw: np.ndarray, off: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of each text raw[off[i]:off[i+1]], followed by `end`."""
        from .textbytes import Words, mix, spans_hash

        n = len(off) - 1
        pad = np.concatenate((raw, np.zeros(16, np.uint8)))
        w = Words(raw, off, _SEPS)
        start, stop, counts = w.start, w.end, w.counts()
        # Texts with other white space, or with a separator at an edge or next to another, go to the library by parts.
        bad = np.zeros(n, bool)
        two, three = pad[1:-15], pad[2:-14]
        odd = _ODD_SPACE[raw] | ((raw == 0xC2) & ((two[: len(raw)] == 0x85) | (two[: len(raw)] == 0xA0)))
        wide = np.flatnonzero((raw >= 0xE1) & (raw <= 0xE3))
        if len(wide):
            a, b, c = raw[wide], pad[wide + 1], pad[wide + 2]
            odd[wide[((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]] = True
        bad[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = True
        seps = np.concatenate(([0], np.cumsum(_SEPS[raw], dtype=np.int64)))
        bad |= (seps[off[1:]] - seps[off[:-1]]) != np.maximum(counts - 1, 0)
        # A word that ends in signs after an ASCII or Latin letter or a digit is two pre-tokens.
        core = stop.copy()
        for _ in range(4):
            core = np.where((core - 1 > start) & _SIGN[raw[core - 1]], core - 1, core) if len(core) else core
        last, before = (raw[core - 1], raw[np.maximum(core - 2, 0)]) if len(core) else (raw[:0], raw[:0])
        whole = ~(_ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (core - 2 >= start))) if len(core) else np.zeros(0, bool)
        core[whole] = stop[whole]
        kind = np.where(raw[np.maximum(start - 1, 0)] == 10, 2, 1) if len(start) else start
        kind[w.bounds[:-1][counts > 0]] = 0
        tail = (core < stop).astype(np.int64)
        at = np.arange(len(start)) + np.concatenate(([0], np.cumsum(tail)[:-1])).astype(np.int64) if len(start) else start
        total = len(start) + int(tail.sum())
        a, z, k = np.empty(total, np.int64), np.empty(total, np.int64), np.zeros(total, np.int64)
        a[at], z[at], k[at] = start, core, kind
        more = np.flatnonzero(tail)
        a[at[more] + 1], z[at[more] + 1] = core[more], stop[more]
        h = mix(spans_hash(raw, a, z) ^ _KINDS[k]) | np.uint64(1)
        eight = np.ndarray((len(raw) + 1,), "<u8", pad.data, 0, (1,))
        size = np.minimum(z - a, 8).astype(np.uint64)
        head = eight[a] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * size)) if total else h
        t = self.table
        if t.count > 1 << 19:
            self.table = t = _Table()
        slot = t.find(h, head)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            _, one = np.unique(h[miss] ^ (head[miss] * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            new = miss[one]
            data = raw.tobytes()
            words = b"\n".join([data[x:y] for x, y in zip(a[new].tolist(), z[new].tolist())]).decode().split("\n")
            t.add(h[new], head[new], self._new(words, k[new].tolist()))
            slot = t.find(h, head)  # the table may have grown
        sizes = t.size[slot].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = t.pool[np.repeat(t.begin[slot] - ends[:-1], sizes) + np.arange(ends[-1])] if total else np.zeros(0, np.uint32)
        unit = np.concatenate((at, [total]))[w.bounds]
        out = [np.concatenate((ids[x:y], end)) for x, y in zip(ends[unit[:-1]].tolist(), ends[unit[1:]].tolist())]
        slow = np.flatnonzero(bad).tolist()
        if slow:
            data = raw.tobytes()
            for i, b in zip(slow, self.encode([data[off[i] : off[i + 1]].decode() for i in slow])):
                out[i] = np.concatenate((np.frombuffer(b, np.uint32), end))
        return out


def encoder(path: str) -> ColumnEncoder:
    """One encoder a process and file."""
    if path not in _encoders:
        _encoders[path] = ColumnEncoder(path)
    return _encoders[path]


def groups(texts: list[str], most: int = 1 << 21):
    """The texts in runs of about `most` characters."""
    run, total = [], 0
    for t in texts:
        run.append(t)
        total += len(t)
        if total >= most:
            yield run
            run, total = [], 0
    if run:
        yield run


def encoded(batch, text: str, path: str, end_id: int | None):
    """One uint32 array for each row of an Arrow batch, with the end id where one is given."""
    from .textbytes import buffer, slices

    enc = encoder(path)
    end = np.array([] if end_id is None else [end_id], np.uint32)
    for part in slices(batch, text, 1 << 20):
        yield from enc.column(*buffer(part.column(part.schema.get_field_index(text))), end)
