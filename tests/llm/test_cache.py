import random
import tracemalloc

import numpy as np

from scholarflow.llm import _tokens as K


def test_small_cache_gives_the_same_ids():
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", f"x{rng.randrange(300)}", "the"]) for _ in range(20)) for _ in range(200)]
    enc = K.PretokenEncoder("byte_bpe_50k.json", limit=40)
    got = [ids for i in range(0, 200, 5) for ids in enc.encode(texts[i : i + 5])]
    assert enc.older
    assert all(np.array_equal(a, b) for a, b in zip(got, enc.library(texts), strict=True))


def test_cache_takes_few_bytes_an_entry():
    """Two full caches of 500,000 entries in each worker took an executor over its memory in the pipeline."""
    rng, n = np.random.default_rng(1), 50_000
    tracemalloc.start()
    try:
        known, added = K.Known(), []
        for _ in range(4):
            keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            known.add(keys, keys ^ np.uint64(5), np.full(len(keys), 2), np.repeat(keys, 2).astype(np.uint32))
            added.append(keys)
        del keys
        assert (tracemalloc.get_traced_memory()[0] - sum(k.nbytes for k in added)) / len(known) < 90
    finally:
        tracemalloc.stop()


def test_cache_finds_by_both_hashes_and_the_last_of_a_key():
    known = K.Known()
    a = lambda *x: np.array(x, np.uint64)
    assert known.find(a(3), a(1)).tolist() == [-1]
    known.add(a(9, 3), a(90, 30), np.array([2, 1]), np.array([7, 8, 5], np.uint32))
    known.add(a(4, 9), a(40, 91), np.array([1, 3]), np.array([6, 1, 2, 3], np.uint32))
    at = known.find(a(2, 3, 4, 9, 9, 10), a(20, 30, 40, 90, 91, 100))
    assert at.tolist() == [-1, 1, 2, -1, 3, -1]
    assert known.ids(at[[1, 2, 4]]).tolist() == [5, 6, 1, 2, 3]
