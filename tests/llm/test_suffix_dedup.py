import hashlib
import random

import numpy as np
import pytest

from rhoscope.llm import suffix_dedup


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh", bytes(range(1, 246))])
def test_two_stage_order_is_the_sorted_order(alphabet):
    rng = random.Random(1)
    raw = b"".join(bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) + b"\0" for _ in range(40))
    text = np.frombuffer(raw, np.uint8)
    order = suffix_dedup.suffix_array(text, 50)
    keys = [raw[i : raw.index(b"\0", i)][:50] for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == [i for i, c in enumerate(raw) if c]
    prefixes = suffix_dedup.common_prefixes(order, suffix_dedup.chunks(text, 50), 50)
    for a, b, n in zip(keys, keys[1:], prefixes[1:].tolist(), strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n >= same if same == min(len(a), len(b)) else n == same


def plain(rows, width):
    last = float("inf")
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            first[b[i : i + width]] = min(first.get(b[i : i + width], last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < (last if d is None else d):
                gone[i : i + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(3), rng.choice(passages))
        rows.append((rng.randrange(10**6) - 1000, " ".join(parts)))
    texts = ["", None, "short", "ä" * 30, "ä" * 24, "x" * 500, "x" * 49, "x" * 50, "ab" * 200, "é\0" * 60, "b" + "x" * 100, "=" * 3000]
    rows += [(10**7 + i, t) for i, t in enumerate(texts)]
    return rows + [(2 * 10**7 + i, t) for i, (_, t) in enumerate(rows[::4])] + [(None, rows[0][1])]


@pytest.mark.parametrize("hot", [50_000, 2])
def test_removed_bytes_are_those_of_all_strings(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_bytes int, tid string").repartition(4)
    key = lambda r: (r[0] is None, r[0], r[4])
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()), key=key)
    assert [(*r[:5], bytes(r[5])) for r in got] == sorted(plain(rows, 50), key=key)
    digests = sorted((tuple(r) for r in suffix_dedup.repeat_digests(df, hot=hot).collect()), key=key)
    assert digests == [r[:5] for r in got]


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.repeat_digests(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "y" * 60), (1, "y" * 60), (2, "y" * 60)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, schema)).collect()) == [(1, 0), (1, 0), (2, 60)]


def test_a_passage_of_all_texts_is_one_entry_of_a_slice():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(1000))

    def sent(n):
        texts = [f"{i:06d}{passage}{i:06d}" for i in range(n)]
        raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.arange(n + 1) * 1012
        keys = [np.unique(k >> np.uint64(64 - suffix_dedup.KEY_BITS)) for k in suffix_dedup._keys(50)(offsets, raw)]
        [(_, base, *packed)], held = suffix_dedup._dealt(raw, offsets, [k.tobytes() for k in keys], [bytes(k.size) for k in keys], np.arange(n, dtype=np.uint64), 50, 1)
        doc, begin, end = suffix_dedup._gone(held, [a for _, a in suffix_dedup._matched([7], [base], [tuple(packed)], 50)], n, 50)
        gone = np.zeros((n, 1013), int)
        np.add.at(gone, (doc, begin), 1)
        np.add.at(gone, (doc, end), -1)
        assert [r[2] for r in plain(list(enumerate(texts)), 50)] == (gone.cumsum(1) > 0).sum(1).tolist()
        return len(suffix_dedup.expanded(packed[1])) // 4, sum(k.size for k in keys)

    (few, few_segments), (many, many_segments) = sent(40), sent(80)
    # Only segments at the passage's two ends differ from text to text.
    assert many - few <= 40 * 8 and many_segments - few_segments > 40 * 30


@pytest.mark.parametrize("parts", [5, 40, 43])
def test_a_block_of_many_slices_is_one_row_of_a_group_of_parts(monkeypatch, parts):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1500)
    rows = sorted((d, t) for d, t in corpus() if d is not None and len((t or "").encode()) >= 50)
    random.Random(3).shuffle(rows)
    matched, blocks, n_rows = {}, [], 0
    for block, own in enumerate((rows[:70], rows[70:])):
        raw = [t.encode() for _, t in own]
        offsets, data = np.r_[0, np.cumsum([len(t) for t in raw])], np.frombuffer(b"".join(raw), np.uint8)
        assert data.size > 4 * suffix_dedup.SLICE_BYTES
        keys = [np.unique(k >> np.uint64(64 - suffix_dedup.KEY_BITS)) for k in suffix_dedup._keys(50)(offsets, data)]
        lows = np.array([d + 10**6 for d, _ in own], np.uint64)
        dealt, held = suffix_dedup._dealt(data, offsets, [k.tobytes() for k in keys], [(k % np.uint64(5) == 0).tobytes() for k in keys], lows, 50, parts, 8)
        for group, base, *packed in dealt:
            matched.setdefault(group, []).append((block, base, tuple(packed)))
        n_rows += len(dealt)
        blocks.append((held, own))
    assert n_rows <= 2 * -(-parts // 8)
    answers = [x for m in matched.values() for x in suffix_dedup._matched(*zip(*m, strict=True), 50)]
    got = {}
    for block, (held, own) in enumerate(blocks):
        doc, begin, end = suffix_dedup._gone(held, [a for b, a in answers if b == block], len(own), 50)
        for i, (d, t) in enumerate(own):
            gone = np.zeros(len(t.encode()), bool)
            for a, b in zip(begin[doc == i], end[doc == i], strict=True):
                gone[a:b] = True
            got[d] = int(gone.sum())
    assert got == {r[0]: r[2] for r in plain(rows, 50)}


def test_rows_of_a_large_corpus_keep_their_size():
    # 10 GB of text, a quarter or all of its segments shared.
    for shared in (0.25, 1):
        text = 10**10
        parts = int(text / 18 * shared * 70 / suffix_dedup.PART_BYTES)
        rows = text / suffix_dedup.BLOCK_BYTES * -(-parts // suffix_dedup.parts_of_group(parts))
        assert text / rows > 10_000


def test_groups_of_parts_and_several_blocks(spark, monkeypatch):
    for name, value in (("PART_BYTES", 1000), ("BLOCK_BYTES", 5000), ("LEAST_GROUPS", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    key = lambda r: (r[0] is None, r[0], r[4])
    digests = sorted((tuple(r) for r in suffix_dedup.repeat_digests(df).collect()), key=key)
    assert digests == [r[:5] for r in sorted(plain(rows, 50), key=key)]
