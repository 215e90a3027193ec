"""Removal of repeated passages with suffix arrays built by two-stage sorting.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller doc_id.

Where the corpus is cut: each window of ``width`` bytes belongs to the smallest hash among the 16-byte strings
in it, so equal windows belong to equal hashes. Consecutive windows with one hash form a segment (about 66
bytes for 17 windows). Hashes are counted over the corpus first (shared.py); only segments whose hash occurs
in several texts travel, to the part of the key space that the hash lies in. A block of text sends equal segments
once, with their smallest and largest doc_ids, and keeps to itself which of its texts hold them where; so a passage
that a third of all texts hold costs its part one entry per block, not per text. A hash of more than ``hot`` texts
would still gather too many different segments in one place; its windows travel one by one, by their own hashes.
A row of the exchange holds what one block has for a group of parts. A block is as large as memory lets it be, though
its bytes are hashed in smaller slices, and a large corpus has several parts in a group; else rows, of which there are
blocks times groups, would soon cost more than what they hold.

A group's parts are worked on one after another. In a part, the distinct segments form one string with separators. Its suffixes are sorted in two stages: those
smaller than their successors directly, by ``width`` bytes; all others by scanning buckets in ascending order
and placing the predecessor of every suffix met. Common prefixes of neighbours then give the groups of equal
windows, and each of these its smallest doc_id, which goes back to the blocks. Exact copies of a text are one text throughout; all but the first
lose every byte that a window covers.

Cases: a null text is empty; texts shorter than ``width`` lose nothing; a null doc_id is larger than all others
(and rows without one are copies of each other; doc_id must be a whole number that fits 64 bits); repeated rows with one doc_id keep the same bytes, as no
document is smaller than itself. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import BYTE_VALUES, U, discard, mix, pack, powers, prefix_hashes, runs, settled, span_hashes, texts_of, trim, unpack
from rhoscope.llm.shared import HASHED_BYTES, KEY_BITS, distinct_texts, planes, shared_keys, text_classes, unplanes

GRAM = 16
PART_BYTES = 4_000_000
#: Bytes of text that are hashed at once, and that rows of the exchange are made of.
SLICE_BYTES, BLOCK_BYTES = 2_000_000, 16_000_000
#: Groups of parts there are at least before a group holds several, and parts of a group at most.
LEAST_GROUPS, GROUP_PARTS = 128, 8
LAST = (1 << 64) - 1


def minima(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within a text, their smallest gram's hash, and the prefix hashes of the bytes."""
    sums = prefix_hashes(data, BYTE_VALUES)
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - width + 1, 0)
    starts = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(windows)[:-1]], windows) + np.arange(windows.sum())
    if not starts.size:
        return starts, np.zeros(0, U), sums
    # span_hashes of every place, without lists of places.
    low = mix((sums[GRAM:] - sums[:-GRAM]) * powers(sums.size)[1][: sums.size - GRAM] + U(GRAM))
    reach, span = 1, width - GRAM + 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    return starts, low[starts], sums


def segments(starts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places (in ``starts``) of runs of consecutive windows with one smallest hash, with the end."""
    if not starts.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (low[1:] != low[:-1])])
    return first, np.r_[first[1:], starts.size]


def chunks(text: np.ndarray, depth: int) -> tuple[np.ndarray, int, int]:
    """For every place, as many characters from there on as fit one number, which compares as they do.

    Also the number of characters, and the bits of each: as few as the text's own characters need.
    """
    present = np.bincount(text, minlength=256) > 0
    codes = np.cumsum(present) - present[0]  # 0 stays 0
    bits = max(1, int(codes[-1]).bit_length())
    many = 64 // bits
    words = np.concatenate([codes.astype(U)[text], np.zeros(depth + 2 * many, U)])
    # Powers of two first; those that ``many`` is the sum of are joined, the largest first.
    held, size = [], 1
    while 2 * size <= many:
        if many & size:
            held.append((size, words))
        words = (words[:-size] << U(bits * size)) | words[size:]
        size *= 2
    for add, tail in reversed(held):
        tail = tail[size:]
        n = min(words.size, tail.size)
        words = (words[:n] << U(bits * add)) | tail[:n]
        size += add
    return words, many, bits


def suffix_array(text: np.ndarray, depth: int, packed: tuple[np.ndarray, int, int] | None = None) -> np.ndarray:
    """Places of ``text`` (bytes, 0 parts strings and ends it) in the order of their first ``depth`` bytes."""
    n = text.size
    steps = np.diff(text.astype(np.int16))
    differs = np.flatnonzero(steps)
    smaller = np.ones(n, bool)  # than its successor; the last suffix has none and is sorted directly
    if differs.size:
        smaller[: differs[-1] + 1] = np.repeat(steps[differs] > 0, np.diff(differs, prepend=-1))
    words, many, _ = packed or chunks(text, depth)
    # First stage: equal starts are told apart by the next characters, until depth.
    direct = np.flatnonzero(smaller & (text > 0)).astype(np.int32)
    key = words[direct]
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    opened = np.r_[True, key[1:] != key[:-1]] if direct.size else np.zeros(0, bool)
    for offset in range(many, depth, many):
        # Places that share their group with a neighbour.
        tied = np.flatnonzero(~(opened & np.r_[opened[1:], True]))
        if not tied.size:
            break
        at, group = direct[tied], np.cumsum(opened[tied]).astype(U)
        key = words[np.minimum(at + offset, n)]
        order = np.argsort(key)
        rank = np.empty(tied.size, U)
        rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        joint = (group << U(32)) | rank
        order = np.argsort(joint)
        direct[tied], joint = at[order], joint[order]
        opened[tied] = np.r_[True, joint[1:] != joint[:-1]]
    heads = np.searchsorted(text[direct], np.arange(257))
    # Second stage: a bucket's larger suffixes come first, in the order in which their successors were met.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        if c:
            bucket, front = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int32)
            while front.size:
                bucket.append(front)
                front = front[front > 0] - 1
                front = front[(text[front] == c) & ~smaller[front]]
            bucket.append(direct[heads[c] : heads[c + 1]])
            placed = np.concatenate(bucket)
            out.append(placed)
        else:
            placed = np.flatnonzero(text == 0).astype(np.int32)
        waiting[c] = []
        before = placed[placed > 0] - 1
        chars = text[before]
        larger = chars > c
        before, chars = before[larger], chars[larger]
        order = np.argsort(chars, kind="stable")
        before, chars = before[order], chars[order]
        edges = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1], True]) if chars.size else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            waiting[chars[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def common_prefixes(order: np.ndarray, packed: tuple[np.ndarray, int, int], most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it (0 for the first), at most ``most``."""
    words, many, bits = packed
    out = np.zeros(order.size, np.int32)
    alike = np.arange(1, order.size, dtype=np.int32)
    for offset in range(0, most, many):
        x = words[order[alike] + offset] ^ words[order[alike - 1] + offset]
        same = x == 0
        out[alike[same]] += many
        left, x = alike[~same], x[~same]
        for k in range(1, many):
            out[left] += x < (U(1) << U(bits * (many - k)))
        alike = alike[same]
    return np.minimum(out, most)


def smallest_owners(raw: np.ndarray, lengths: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct segment's windows, in order, the smallest owner of any segment that holds the window.

    Also the place of each segment's first window in that list.
    """
    ends = np.cumsum(lengths)
    # UTF-8 has no byte above 0xF4, so one more leaves 0 for the separator.
    text = np.zeros(raw.size + lengths.size, np.uint8)
    inside = np.ones(text.size, bool)
    inside[ends + np.arange(lengths.size)] = False
    text[inside] = raw + 1
    del inside
    begin = ends - lengths + np.arange(lengths.size)
    windows = lengths - width + 1
    first = np.r_[0, np.cumsum(windows)]
    places = np.repeat(begin - first[:-1], windows) + np.arange(first[-1])
    number = np.full(text.size, -1, np.int32)
    number[places] = np.arange(places.size, dtype=np.int32)
    packed = chunks(text, width)
    order = suffix_array(text, width, packed)
    order = order[number[order] >= 0]
    group = np.cumsum(common_prefixes(order, packed, width) < width) - 1
    window = number[order]
    owner = np.repeat(owners, windows)[window]
    least = np.full(group[-1] + 1 if group.size else 0, LAST, U)
    np.minimum.at(least, group, owner)
    out = np.empty(places.size, U)
    out[window] = least[group]
    return out, first


def squeezed(raw: bytes) -> bytes:
    """Text and places travel in zstd, which halves what Spark's own codec leaves of them."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expanded(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def _keys(width: int):
    def keys_of(offsets, data):
        starts, low, _ = minima(data, offsets, width)
        first, _ = segments(starts, low)
        doc = np.searchsorted(offsets, starts[first], "right") - 1
        keys = mix(low[first])
        edges = np.searchsorted(doc, np.arange(offsets.size))
        return [np.unique(keys[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    return keys_of


def repeated_spans(documents: DataFrame, classes: DataFrame, width: int, hot: int) -> DataFrame:
    """(tid, starts, ends): packed, merged spans of bytes that an earlier text has as well."""
    total = classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    def finish(n, keys, counts):
        order = np.argsort(keys)
        return (keys[order].tobytes(), (counts[order] > hot).tobytes(), keys.size) if keys.size else (None, None, 0)

    fields = [("keys", pa.binary(), "binary"), ("often", pa.binary(), "binary"), ("e", pa.int64(), "long")]
    found = shared_keys(documents.select("text"), total // 17 + 1, _keys(width), finish, fields).filter("keys is not null")
    lows = classes.groupBy(F.col("tid").alias("_l")).agg(F.min("doc_id").alias("low"))
    found = settled(found.groupBy("tid").agg(*(F.first(c).alias(c) for c in ("keys", "often", "e"))).join(lows, F.col("tid") == F.col("_l")).select(F.col("tid").alias("_t"), "keys", "often", "e", F.col("low").cast("long").alias("low")))
    parts = max(1, -(-(found.agg(F.coalesce(F.sum("e"), F.lit(0))).first()[0] * 70) // PART_BYTES))
    group = parts_of_group(parts)
    groups = -(-parts // group)

    def emit(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            offsets, data = texts_of(batch.column("text"))
            lows = np.array([LAST if v is None else v + (1 << 63) for v in batch.column("low").to_pylist()], U)
            keys, often = batch.column("keys").to_pylist(), batch.column("often").to_pylist()
            for i, j in runs(offsets, BLOCK_BYTES):
                block = (task << 24) + n
                n += 1
                own = offsets[i : j + 1] - offsets[i]
                raw = data[offsets[i] : offsets[j]]
                rows, held = _dealt(raw, own, keys[i:j], often[i:j], lows[i:j], width, parts, group)
                if not rows:
                    continue
                tids = b"".join(batch.column("tid").slice(i, j - i).to_pylist())
                columns = list(zip(*rows, strict=True))
                none = [None] * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*columns[0], block % groups], pa.int32()), pa.array([block] * (len(rows) + 1), pa.int64()), pa.array([*columns[1], None], pa.int64()), *(pa.array([*c, None], pa.binary()) for c in columns[2:]), pa.array([*none, tids], pa.binary()), pa.array([*none, held], pa.binary())],
                    names=["group", "block", "base", "lows", "lengths", "contents", "counts", "tids", "held"],
                )
                del rows, columns, held
                trim()

    def match(table: pa.Table) -> pa.Table:
        blocks, base, lows, lengths, contents, counts, tids, held = (table.column(c).to_pylist() for c in ("block", "base", "lows", "lengths", "contents", "counts", "tids", "held"))
        out = [(b, None, t, h) for b, t, h in zip(blocks, tids, held, strict=True) if t is not None]
        own = [i for i, t in enumerate(tids) if t is None]
        if own:
            out += [(b, a, None, None) for b, a in _matched([blocks[i] for i in own], [base[i] for i in own], [(lows[i], lengths[i], contents[i], counts[i]) for i in own], width)]
            trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["block", "answers", "tids", "held"])

    def gather(table: pa.Table) -> pa.Table:
        answers, tids, held = (table.column(c).to_pylist() for c in ("answers", "tids", "held"))
        about = next(i for i, t in enumerate(tids) if t is not None)
        names = tids[about]
        doc, starts, ends = _gone(held[about], [a for a in answers if a is not None], len(names) // 16, width)
        order = np.lexsort((starts, doc))
        doc, starts, ends = doc[order], starts[order], ends[order]
        edges = np.searchsorted(doc, np.arange(len(names) // 16 + 1))
        rows = []
        for d in np.flatnonzero(np.diff(edges)):
            a, b = starts[edges[d] : edges[d + 1]], np.maximum.accumulate(ends[edges[d] : edges[d + 1]])
            first = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
            rows.append((names[16 * d : 16 * d + 16], a[first].tobytes(), b[np.r_[first[1:] - 1, a.size - 1]].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["tid", "starts", "ends"])

    placed = distinct_texts(documents).join(found, F.col("tid") == F.col("_t")).select("tid", "text", "keys", "often", "low")
    emitted = placed.mapInArrow(emit, "group int, block long, base long, lows binary, lengths binary, contents binary, counts binary, tids binary, held binary")
    matched = emitted.groupBy("group").applyInArrow(match, "block long, answers binary, tids binary, held binary")
    spans = matched.groupBy("block").applyInArrow(gather, "tid binary, starts binary, ends binary")
    out = settled(spans.groupBy("tid").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends")))
    discard(found)
    return out


def parts_of_group(parts: int) -> int:
    return min(GROUP_PARTS, max(1, parts // LEAST_GROUPS))


def _dealt(raw, offsets, keys, often, lows, width, parts, group=1):
    """Rows (group, base, lows, lengths, contents, counts) of a block: its shared segments, equal ones once, numbered from base on.

    counts says how many of a row's segments, which come in the order of parts, each part of the group has. With them goes
    what the block keeps: its texts' doc_ids, and of every segment the text, the place in it, and the number.
    """
    found = []
    for i, j in runs(offsets, SLICE_BYTES):
        begin, stop, owner, *names = _shared_segments(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], keys[i:j], often[i:j], width)
        found.append((begin + offsets[i], stop + offsets[i], owner + i, *names))
    begin, stop, owner, key, name = map(np.concatenate, zip(*found, strict=True))
    del found
    if not begin.size:
        return [], None
    _, one, content = np.unique(name, return_index=True, return_inverse=True)
    del name
    least, most = np.full(one.size, LAST, U), np.zeros(one.size, U)
    np.minimum.at(least, content, lows[owner])
    np.maximum.at(most, content, lows[owner])
    part = np.searchsorted((np.arange(1, parts, dtype=np.float64) / parts * 2.0**KEY_BITS).astype(U), key[one], "right")
    order = np.lexsort((begin[one], least, part))
    number = np.empty(one.size, np.int64)
    number[order] = np.arange(one.size)
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for first in range(0, parts, group):
        own = edges[first : first + group + 1]
        at = order[own[0] : own[-1]]
        if at.size:
            lengths = (stop - begin)[one[at]]
            rows.append((first // group, int(own[0]), *map(squeezed, (pack(least[at]) + pack(most[at] - least[at]), planes(lengths), _selected(raw, begin[one[at]], lengths).tobytes())), planes(np.diff(own))))
    place = begin - offsets[owner]
    order = np.lexsort((place, owner))
    return rows, squeezed(pack(lows) + planes(owner[order]) + planes(place[order]) + planes(number[content[order]]))


def _shared_segments(raw, offsets, keys, often, width):
    """Start, end, text, key and name of the segments of a slice that other texts may hold; equal segments have one name."""
    starts, low, sums = minima(raw, offsets, width)
    first, end = segments(starts, low)
    doc = np.searchsorted(offsets, starts[first], "right") - 1
    key = mix(low[first]) >> U(64 - KEY_BITS)
    edges = np.searchsorted(doc, np.arange(offsets.size))
    state = np.zeros(first.size, np.int8)
    for d in np.flatnonzero(np.diff(edges)):
        a, b = edges[d], edges[d + 1]
        own = np.frombuffer(keys[d], U)
        at = np.minimum(np.searchsorted(own, key[a:b]), own.size - 1)
        state[a:b] = (own[at] == key[a:b]) * (1 + np.frombuffer(often[d], bool)[at])
    cold, hot = state == 1, state == 2
    begin, stop = starts[first[cold]], starts[end[cold] - 1] + width
    key, owner = key[cold], doc[cold]
    if hot.any():
        sizes = end[hot] - first[hot]
        each = np.repeat(starts[first[hot]] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        begin, stop = np.r_[begin, each], np.r_[stop, each + width]
        owner = np.r_[owner, np.repeat(doc[hot], sizes)]
        key = np.r_[key, mix(span_hashes(sums, each, each + width)) >> U(64 - KEY_BITS)]
    return begin, stop, owner, key, mix(span_hashes(sums, begin, stop) + key)


def _gone(held, answers, n, width):
    """Texts, starts and ends of what an earlier text holds too, from what a block of n texts kept and the answers to it."""
    held, answers = expanded(held), list(map(expanded, answers))
    lows, m = unpack(held[: 8 * n]), (len(held) - 8 * n) // 12
    doc, place, number = (unplanes(held[8 * n + 4 * m * k : 8 * n + 4 * m * (k + 1)]).astype(np.int64) for k in range(3))
    if not answers:
        return np.zeros((3, 0), np.int64)
    runs_of = [[unplanes(a[len(a) // 5 * k : len(a) // 5 * (k + 1)]).astype(np.int64) for a in answers] for k in range(3)]
    segment, opened, closed = map(np.concatenate, runs_of)
    least = np.concatenate([unpack(a[len(a) // 5 * 3 :]) for a in answers])
    order = np.argsort(segment, kind="stable")
    segment, opened, closed, least = segment[order], opened[order], closed[order], least[order]
    first = np.searchsorted(segment, number)
    many = np.searchsorted(segment, number, "right") - first
    run = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    at = np.repeat(np.arange(m), many)
    later = least[run] < lows[doc[at]]
    run, at = run[later], at[later]
    return doc[at], place[at] + opened[run], place[at] + closed[run] - 1 + width


def _first_minima(sums, starts, width):
    """The smallest hash of the grams in the first window of each segment."""
    grams = np.arange(width - GRAM + 1)
    out = []
    for i in range(0, starts.size, 20_000):
        at = starts[i : i + 20_000, None] + grams
        out.append(span_hashes(sums, at, at + GRAM).min(1))
    return np.concatenate(out) if out else np.zeros(0, U)


def _hashes(raw, lengths, of):
    """What ``of`` makes of prefix hashes, starts and ends of segments that follow one another, some at a time."""
    edges = np.r_[0, np.cumsum(lengths)]
    out = [of(prefix_hashes(raw[edges[i] : edges[j]], BYTE_VALUES), edges[i:j] - edges[i], edges[i + 1 : j + 1] - edges[i]) for i, j in runs(edges, HASHED_BYTES)]
    return np.concatenate(out) if out else np.zeros(0, U)


def _selected(raw, starts, lengths):
    return raw[np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())]


def _matched(blocks, bases, rows, width):
    """(block, answer): for each row runs of its segments' windows with the smallest doc_id that holds them.

    Runs that no text of the row comes after are left out.
    """
    cuts = [np.r_[0, np.cumsum(unplanes(r[3]).astype(np.int64))] for r in rows]
    lengths = [unplanes(expanded(r[1])).astype(np.int64) for r in rows]
    ends = [np.r_[0, np.cumsum(n)][c].tolist() for n, c in zip(lengths, cuts, strict=True)]
    raw = [np.frombuffer(expanded(r[2]), np.uint8) for r in rows]
    cuts, lows, overs = [c.tolist() for c in cuts], [], []
    for r, n in zip(rows, lengths, strict=True):
        low = expanded(r[0])
        lows.append(unpack(low[: 8 * n.size]))
        overs.append(unpack(low[8 * n.size :]))
    del rows
    out = []
    for q in range(len(cuts[0]) - 1):
        own = [i for i, c in enumerate(cuts) if c[q] < c[q + 1]]
        if not own:
            continue
        low, over, length = (np.concatenate([x[i][cuts[i][q] : cuts[i][q + 1]] for i in own]) for x in (lows, overs, lengths))
        place, *runs_of = _part_matched(np.concatenate([raw[i][ends[i][q] : ends[i][q + 1]] for i in own]), length, low, low + over, width)
        sizes = np.array([cuts[i][q + 1] - cuts[i][q] for i in own])
        row = np.repeat(own, sizes)[place]
        number = np.repeat([bases[i] + cuts[i][q] for i in own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)[place] + place
        out.append((row, number, *runs_of))
    row, number, opened, closed, least = map(np.concatenate, zip(*out, strict=True))
    del out
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(blocks) + 1))
    answers = []
    for block, a, b in zip(blocks, edges[:-1], edges[1:], strict=True):
        if a < b:
            at = order[a:b]
            answers.append((block, squeezed(planes(number[at]) + planes(opened[at]) + planes(closed[at]) + pack(least[at]))))
    return answers


def _part_matched(raw, length, low, most, width):
    """Segment, first and last window and smallest doc_id of runs of a part's segments' windows; low and most are each one's doc_ids."""
    _, one, content = np.unique(_hashes(raw, length, span_hashes), return_index=True, return_inverse=True)
    raw = _selected(raw, (np.cumsum(length) - length)[one], length[one])
    owners = np.full(one.size, LAST, U)
    np.minimum.at(owners, content, low)
    size = length[one]
    windows = size - width + 1
    first = np.r_[0, np.cumsum(windows)]
    # Equal windows have one smallest hash; a segment that is alone with its hash shares no window.
    gram = _hashes(raw, size, lambda sums, starts, ends: _first_minima(sums, starts, width))
    _, alike, times = np.unique(gram, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[alike] > 1)
    if some.size:
        raw, n = _selected(raw, (np.cumsum(size) - size)[some], size[some]), size[some]
        found, begin = smallest_owners(raw, n, owners[some], width)
    least = np.repeat(owners, windows)
    if some.size:
        least[np.repeat(first[some] - begin[:-1], windows[some]) + np.arange(found.size)] = found
    edge = np.r_[True, least[1:] != least[:-1]]
    edge[first[:-1]] = True
    opened = np.flatnonzero(edge)
    closed, run_of = np.r_[opened[1:], least.size], np.searchsorted(opened, first)
    many = np.diff(run_of)[content]
    place = np.repeat(np.arange(content.size), many)
    run = np.repeat(run_of[content] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    some = least[opened[run]] < most[place]
    place, run = place[some], run[some]
    begin = first[content[place]]
    return place, opened[run] - begin, closed[run] - begin, least[opened[run]]


def remove_repeats(documents: DataFrame, width: int = 50, hot: int = 50_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept is what is left, as bytes."""
    return _results(documents, width, hot, True)


def repeat_digests(documents: DataFrame, width: int = 50, hot: int = 50_000) -> DataFrame:
    """remove_repeats without the remaining bytes."""
    return _results(documents, width, hot, False)


def _results(documents: DataFrame, width: int, hot: int, whole: bool) -> DataFrame:
    rows = documents.select("doc_id", "text")
    classes = text_classes(rows)
    spans = repeated_spans(rows, classes, width, hot).select(F.col("tid").alias("_s"), "starts", "ends")

    def work(batches):
        for batch in batches:
            offsets, data = texts_of(batch.column("text"))
            out = []
            for i, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                a, b = np.frombuffer(starts or b"", np.int64), np.frombuffer(ends or b"", np.int64)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                out.append((len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if whole else None))
            yield pa.RecordBatch.from_arrays([batch.column("tid"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["_w", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = distinct_texts(rows).join(spans, F.col("tid") == F.col("_s"), "left" if whole else "inner").select("tid", "text", "starts", "ends")
    cut = texts.mapInArrow(work, "_w binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = settled(cut.groupBy("_w").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept"))))
    lows = classes.groupBy(F.col("tid").alias("_l")).agg(F.min("doc_id").alias("low"))
    # A text that loses nothing keeps the hash of the whole; that is made from the table's own text.
    plain = settled(rows.select("doc_id", text_digest().alias("whole_sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))).withColumn("tid", F.unhex(F.substring("whole_sha256", 1, 32)))
    # What belongs to a text is put together first; then one join, whose skewed side Spark can split, meets the copies.
    about = lows.join(cut, F.col("_l") == F.col("_w"), "left").drop("_w")
    joined = plain.join(settled(about), F.col("tid") == F.col("_l"))
    copy = ~F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("n_bytes") >= width)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    if whole:
        columns.append(F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", F.lit(b""))).alias("kept"))
    return joined.select("doc_id", "n_bytes", *columns)


def text_digest():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
