"""Which keys of a text occur in other texts too, counted over the whole corpus without moving any text.

Mappers send each part of the key space the keys of their texts, packed; a part counts every key and answers
with the keys that occur more than once; answers come together per group of texts. Only packed keys are
shuffled (about 6 bytes each), and of the answers only what is shared. A key that several texts of one slice hold
is one entry with their number, while the list of those texts stays with the slice; so a key that a third of all
texts hold costs its part one entry per slice, not per text. Parts are sized by the number of all keys.

Slices of text are named by task and place, so ``documents`` must give the same rows in the same order when a
lost task runs again: a table does; write anything else to one first, as the pipeline does between stages.

Exact copies share one text id (128 bits of SHA-256). Copies in one Arrow batch are taken once; copies that
meet only later make their own keys count as shared, which is harmless to both users.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import U, pack, runs, settled, texts_of, trim, unpack

#: Keys of a part and bytes of text that are worked on at once.
PART_KEYS, SLICE_BYTES = 1_500_000, 8_000_000
#: Bytes that are hashed at once: numpy needs some ten words for each.
HASHED_BYTES = 1_000_000
#: Keys keep their highest 48 bits: by chance two of a pair of texts' keys agree once in 10**9 pairs.
KEY_BITS = 48
#: In the place of a text's number: this and how many of a slice's texts hold the key.
SEVERAL = 1 << 31
#: Counts end here; nothing but their order and whether they pass a bound is asked of them.
MOST = (1 << 32) - 1


def text_id(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, tid, n_bytes) of every row, in the shared folder; a null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return settled(documents.select("doc_id", text_id(text).alias("tid"), F.octet_length(text).cast("long").alias("n_bytes")))


def without_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    seen: dict[bytes, int] = {}
    for i, t in enumerate(batch.column("tid").to_pylist()):
        seen.setdefault(t, i)
    return batch if len(seen) == batch.num_rows else batch.take(pa.array(list(seen.values()), pa.int32()))


def named_texts(documents: DataFrame) -> DataFrame:
    """(tid, text) of every text that isn't empty."""
    return documents.filter("text is not null and text <> ''").select(text_id(F.col("text")).alias("tid"), "text")


def distinct_texts(documents: DataFrame) -> DataFrame:
    """named_texts without the copies that meet in one Arrow batch."""
    return named_texts(documents).mapInArrow(lambda batches: map(without_copies, batches), "tid binary, text string")


def spread(keys: np.ndarray, docs: np.ndarray, parts: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Keys (48 bits) and what belongs to them, in key order, by part of the key space."""
    if (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        del order
    edges = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.float64) / parts * 2.0**KEY_BITS).astype(U))
    return [(p, keys[a:b], docs[a:b]) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]


def laid_out(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The highest bits of all texts' keys, and the numbers of the texts; ``lists`` is emptied, as both need not be held."""
    docs = np.repeat(np.arange(len(lists), dtype=np.uint32), [len(x) for x in lists])
    keys = np.concatenate([np.zeros(0, U), *lists])
    lists.clear()
    keys >>= U(64 - KEY_BITS)
    return keys, docs


def combined(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each one's text or SEVERAL + how many, and the texts of those keys, in key order."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    del order
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, np.int64)
    times = np.diff(np.r_[first, keys.size]).astype(np.uint32)
    return keys[first], np.where(times > 1, np.uint32(SEVERAL) + times, docs[first]), docs[np.repeat(times > 1, times)]


def separated(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per key and text again, from combined keys in any order and the texts of the SEVERAL ones."""
    many = np.flatnonzero(docs >= SEVERAL)
    many = many[np.argsort(keys[many])]
    times = (docs[many] - U(SEVERAL)).astype(np.int64)
    one = docs < SEVERAL
    return np.r_[keys[one], np.repeat(keys[many], times)], np.r_[docs[one], several], np.r_[counts[one], np.repeat(counts[many], times)]


def shared_keys(documents: DataFrame, total_keys: int, keys_of: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], finish: Callable[[int, np.ndarray, np.ndarray], tuple], fields: list[tuple[str, pa.DataType, str]], slice_bytes: int = SLICE_BYTES, part_keys: int = PART_KEYS) -> DataFrame:
    """Per text: tid, and what ``finish(n_keys, shared keys, their counts)`` makes of its keys.

    A row of the exchange holds the keys of one slice of text in one part. Both sizes should follow the
    executors' memory: with s slices and p parts there are s * p rows at most.

    ``keys_of(offsets, bytes)`` gives each text's distinct 64-bit keys. Shared keys come in order of count,
    then key. A text whose copies met in no batch appears more than once, with the same values.
    """
    parts = max(1, -(-total_keys // part_keys))

    def emit(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in map(without_copies, batches):
            offsets, data = texts_of(batch.column("text"))
            for i, j in runs(offsets, slice_bytes):
                lists = [x for a, b in runs(offsets[i : j + 1], HASHED_BYTES) for x in keys_of(offsets[i + a : i + b + 1] - offsets[i + a], data[offsets[i + a] : offsets[i + b]])]
                sizes = np.array([len(x) for x in lists], np.int64)
                keys, docs, several = combined(*laid_out(lists))
                rows = spread(keys, docs, parts)
                block = (task << 24) + n
                n += 1
                tids = b"".join(batch.column("tid").slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p for p, _, _ in rows] + [block % parts], pa.int32()),
                        pa.array([block] * (len(rows) + 1), pa.int64()),
                        pa.array([pack(k) for _, k, _ in rows] + [tids], pa.binary()),
                        pa.array([planes(d) for _, _, d in rows] + [planes(several)], pa.binary()),
                        pa.array([None] * len(rows) + [sizes.tobytes()], pa.binary()),
                    ],
                    names=["part", "block", "keys", "docs", "sizes"],
                )
                del lists, keys, docs, several, rows
                trim()

    def count(table: pa.Table) -> pa.Table:
        blocks, keys, docs, sizes = (table.column(c).to_pylist() for c in ("block", "keys", "docs", "sizes"))
        out = [(b, k, d, None, s) for b, k, d, s in zip(blocks, keys, docs, sizes, strict=True) if s is not None]
        own = [i for i, s in enumerate(sizes) if s is None]
        if own:
            lists = [unpack(keys[i]) for i in own]
            lengths = np.array([x.size for x in lists])
            every, row = np.concatenate(lists), np.repeat(np.arange(len(own), dtype=np.int32), lengths)
            del lists
            order = np.argsort(every, kind="stable")
            every, row, doc = every[order], row[order], np.concatenate([unplanes(docs[i]) for i in own])[order]
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            times = np.add.reduceat(np.where(doc >= SEVERAL, doc - U(SEVERAL), U(1)), first)
            often = np.repeat(np.minimum(times, U(MOST)), np.diff(np.r_[first, every.size]))
            kept = np.flatnonzero(often > 1)
            every, row, doc, often = every[kept], row[kept], doc[kept], often[kept]
            back = np.argsort(row, kind="stable")
            edges = np.searchsorted(row[back], np.arange(len(own) + 1))
            for i, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a < z:
                    at = back[a:z]
                    out.append((blocks[own[i]], pack(every[at]), planes(doc[at]), planes(often[at]), None))
            del every, row, order, times, often, doc, back
            trim()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], names=["block", "keys", "docs", "counts", "sizes"])

    def gather(table: pa.Table) -> pa.Table:
        keys, docs, counts, sizes = (table.column(c).to_pylist() for c in ("keys", "docs", "counts", "sizes"))
        about = next(i for i, s in enumerate(sizes) if s is not None)
        n_keys = np.frombuffer(sizes[about], np.int64)
        tids = [keys[about][i : i + 16] for i in range(0, 16 * n_keys.size, 16)]
        rest = [i for i, s in enumerate(sizes) if s is None]
        if rest:
            key, doc, often = np.concatenate([unpack(keys[i]) for i in rest]), np.concatenate([unplanes(docs[i]) for i in rest]), np.concatenate([unplanes(counts[i]) for i in rest])
            key, doc, often = separated(key, doc, often, unplanes(docs[about]))
            order = np.lexsort((key, often, doc))
            key, doc, often = key[order], doc[order], often[order]
        else:
            key = doc = often = np.zeros(0, U)
        edges = np.searchsorted(doc, np.arange(n_keys.size + 1))
        rows = [finish(int(n), key[a:b], often[a:b]) for n, a, b in zip(n_keys, edges[:-1], edges[1:], strict=True)]
        columns = zip(*rows, strict=True)
        return pa.table([pa.array(tids, pa.binary()), *(pa.array(c, t) for c, (_, t, _) in zip(columns, fields, strict=True))], names=["tid", *(f[0] for f in fields)])

    emitted = named_texts(documents).mapInArrow(emit, "part int, block long, keys binary, docs binary, sizes binary")
    counted = emitted.groupBy("part").applyInArrow(count, "block long, keys binary, docs binary, counts binary, sizes binary")
    return counted.groupBy("block").applyInArrow(gather, ", ".join(["tid binary", *(f"{n} {k}" for n, _, k in fields)]))


def planes(values: np.ndarray) -> bytes:
    """Integers below 2**32 in byte planes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(U)
