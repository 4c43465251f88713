"""Buckets of words and blocks of texts travel as compressed blobs, so that no executor's JVM holds their arrays."""

import numpy as np

from emberline.llm import lm


def test_a_bucket_travels_as_blobs():
    r = np.random.default_rng(1)
    contexts = lm.Contexts(np.sort(r.integers(0, 2**62, 20).astype(np.uint64)), r.integers(1, lm.CLASSES, 20))
    owner = np.repeat(np.arange(300), 4)
    at = np.sort(r.integers(0, contexts.size + lm.CLASSES, len(owner)).reshape(-1, 4), axis=1).reshape(-1)
    far = int((at >= contexts.size).sum())
    s = lm.Seats.first(contexts, r.integers(0, 2**62, 300).astype(np.uint64), owner, at, r.integers(2, 9, len(at)), r.integers(0, 2**62, far).astype(np.uint64), r.integers(0, 9, far), r.integers(1, 9, far))
    row = lm._row(3, s)
    assert {str(t) for t in row.schema.types} == {"int32", "binary"}
    [(bucket, _, got)] = lm._buckets(contexts, [row])
    assert bucket == 3
    for name in ("h", "owner", "r", "n", "t", "tables", "top", "drawn", "k", "s", "m", "seen"):
        assert np.array_equal(getattr(got, name), getattr(s, name)), name


def test_columns_by_gaps_and_by_bytes_come_back():
    r = np.random.default_rng(2)
    x = np.unique(r.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    y = r.integers(0, 70_000, 900).astype(np.int32)
    for columns in ((x, y, np.arange(5)), (x[:0], y[:0], np.arange(0))):
        got = lm._unzip(("+<u8", "|<i4", "<i8"), lm._zip(("+<u8", "|<i4", "<i8"), *columns))
        assert all(np.array_equal(a, b) for a, b in zip(columns, got))
