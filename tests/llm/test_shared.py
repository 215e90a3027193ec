import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rhoscope.llm import shared
from rhoscope.llm.common import shingles, word_hashes


@pytest.mark.parametrize("size", [0, 1, 400])
def test_separated_entries_are_those_combined(size):
    rng = np.random.default_rng(size)
    pairs = np.unique(np.stack([rng.integers(0, 40, size), rng.integers(0, 30, size)]), axis=1).astype(np.uint64)
    keys, docs = pairs[0], pairs[1].astype(np.uint32)
    alone, names, several = shared.combined(keys, docs)
    assert alone.tolist() == sorted(set(keys.tolist()))
    names = shared.unplanes(shared.planes(names))
    mixed = rng.permutation(alone.size)
    got = shared.separated(alone[mixed], names[mixed], alone[mixed] + np.uint64(7), several.astype(np.uint64))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted((k, d, k + 7) for k, d in zip(keys.tolist(), docs.tolist(), strict=True))


def test_one_key_of_all_texts_is_one_entry_of_a_slice():
    keys, docs = np.full(5000, 9, np.uint64), np.arange(5000, dtype=np.uint32)
    alone, names, several = shared.combined(keys, docs)
    assert (alone.tolist(), names.tolist()) == ([9], [shared.SEVERAL + 5000]) and several.tolist() == docs.tolist()


@pytest.mark.parametrize(("slice_bytes", "part_keys"), [(40, 30), (700, 500), (10**6, 10**6)])
def test_counts_are_those_of_all_texts(spark, slice_bytes, part_keys):
    rng = random.Random(slice_bytes)
    texts = [" ".join(["all", "of", "them"] * (i % 3 > 0) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(25))]) + f" end{i}" for i in range(90)]

    def keys_of(offsets, data):
        words, first = word_hashes(data, offsets)
        return [shingles(words[first[i] : first[i + 1]], 1) for i in range(offsets.size - 1)]

    def finish(n, keys, counts):
        return n, keys.view(np.int64).tolist(), counts.astype(np.int64).tolist()

    fields = [("n", pa.int64(), "long"), ("keys", pa.list_(pa.int64()), "array<long>"), ("counts", pa.list_(pa.int64()), "array<long>")]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3)
    got = shared.shared_keys(df, 1000, keys_of, finish, fields, slice_bytes=slice_bytes, part_keys=part_keys).collect()
    holders = Counter(w for t in texts for w in set(t.split()))
    often = lambda t: sorted(holders[w] for w in set(t.split()) if holders[w] > 1)
    assert sorted((r.n, r.counts) for r in got) == sorted((len(set(t.split())), often(t)) for t in texts)
    by_key = {}
    for r in got:
        for key, count in zip(r.keys, r.counts, strict=True):
            by_key.setdefault(key, []).append(count)
    assert all(set(c) == {len(c)} for c in by_key.values())
    assert len(by_key) == sum(c > 1 for c in holders.values())
