import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rhoscope.llm import common, lm_score, ngram_join, shared

numbers = st.lists(st.integers(0, 2**64 - 1), max_size=50)


@given(numbers)
def test_packed_keys_come_back(values):
    keys = np.unique(np.array(values, np.uint64))
    assert common.unpack(common.pack(keys)).tolist() == keys.tolist()
    small = keys >> np.uint64(32)
    assert shared.unplanes(shared.planes(small)).tolist() == small.tolist()
    narrow = keys >> np.uint64(16)
    assert ngram_join.wide(ngram_join.narrow(narrow)).tolist() == narrow.tolist()
    counts = (keys >> np.uint64(20)).astype(np.int64)
    assert lm_score.unnumbers(lm_score.numbers(counts)).tolist() == counts.tolist()


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c ", max_size=30)), max_size=8), st.integers(1, 40))
def test_words_of_texts_in_any_cut(texts, most):
    offsets, data = common.texts_of(pa.array(texts, pa.string()))
    assert offsets.size == len(texts) + 1
    got, known = [], {}
    for i, j in common.runs(offsets, most):
        hashes, first = common.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        got += [hashes[first[k] : first[k + 1]].tolist() for k in range(j - i)]
    for text, hashes in zip(texts, got, strict=True):
        words = brute.WORDS.findall(brute.lowered(text or ""))
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_sliced_columns_and_chunks():
    column = pa.array(["one", None, "two words", "", "x"], pa.string())
    for part in (column[1:4], pa.chunked_array([column[:2], column[2:]]), pa.chunked_array([], pa.string())):
        offsets, data = common.texts_of(part)
        raw = data.tobytes()
        assert [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [t or "" for t in part.to_pylist()]


def test_spread_covers_every_key_once():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 48, 1000).astype(np.uint64)
    for parts in (1, 3, 64):
        rows = shared.spread(keys, np.arange(1000), parts)
        assert sorted(d for _, _, docs in rows for d in docs) == list(range(1000))
        assert all((k[:-1] <= k[1:]).all() for _, k, _ in rows) and [p for p, _, _ in rows] == sorted(p for p, _, _ in rows)
