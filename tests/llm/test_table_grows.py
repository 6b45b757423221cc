"""More new words at once than the word table has slots."""

import numpy as np


def test_table_grows():
    from lorewell.llm.tokens import _Table

    t, rng = _Table(4), np.random.default_rng(1)
    h, head = rng.integers(1, 1 << 63, 1000, np.uint64) | np.uint64(1), np.arange(1000, dtype=np.uint64)
    ids = [np.array([i] * (i % 3 + 1), np.uint32).tobytes() for i in range(1000)]
    for a, b in ((0, 5), (5, 900), (900, 1000)):
        assert (t.find(h[a:b], head[a:b]) < 0).all()
        t.add(h[a:b], head[a:b], ids[a:b])
    at = t.find(h, head)
    assert [t.pool[t.begin[k] : t.begin[k] + t.size[k]].tobytes() for k in at] == ids and t.count == 1000
    assert (t.find(h + np.uint64(2), head) < 0).all()


def test_ids_stay_right_when_the_table_grows():
    """Words found before a slice's new ones were added keep their ids."""
    import numpy as np
    import public_tokenizers

    from lorewell.llm.textbytes import buffer
    from lorewell.llm.tokens import ColumnEncoder, _Table
    from lorewell.llm.piece_tokens import Unigram
    import pyarrow as pa

    known, new = " ".join(f"w{i}" for i in range(900)), " ".join(f"v{i}" for i in range(3000))
    enc = ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.table = _Table(11)
    for texts in ([known], [known, known + " " + new]):
        got = enc.column(*buffer(pa.array(texts)), np.array([], np.uint32))
        assert [x.tolist() for x in got] == [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    m = Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    m.units = _Table(11)
    for texts in ([known], [known, known + " " + new]):
        for t, x in zip(texts, m.encode(pa.array([" " + t for t in texts]))):
            assert m.decode(x).decode() == " " + t
