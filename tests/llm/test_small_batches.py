"""Workers turn a bounded part of a batch into Python strings at a time."""

import numpy as np
import pyarrow as pa

from ledgerlens.llm import minhash
from ledgerlens.llm.tokenize import small_batches


def test_slices_hold_all_rows_and_little_text():
    texts = ["x" * (k * 37 % 90) if k % 7 else None for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(texts), pa.array(texts[::-1])], names=["k", "a", "b"])
    parts = list(small_batches([batch, batch.slice(0, 0)], 1, 2, limit=1000))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert max(sum(len(t or "") for c in (1, 2) for t in p.column(c).to_pylist()) for p in parts) <= 1000 + 180


def test_word_hashes_keep_little_and_do_not_depend_on_blocks(monkeypatch):
    texts = ["le chat " * 60_000, "y" * 1_300_000 + " z", None, "a b c"]
    owner, value = minhash.word_hashes(texts)
    assert max(map(len, minhash._POWERS.values())) < 1_500_000
    monkeypatch.setattr(minhash, "_BYTES", 4 << 20)
    other = minhash.word_hashes(texts)
    assert np.array_equal(owner, other[0]) and np.array_equal(value, other[1])
    minhash._POWERS.clear()
