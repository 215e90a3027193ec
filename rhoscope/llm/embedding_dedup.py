"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

A normalised vector x falls into cell floor((a x + b) / width) for a Gaussian a and a uniform b; ``depth``
cells together name a bucket, and there are several tables of buckets. Depth follows the number of vectors,
so that a bucket holds few unrelated ones, and the number of tables follows depth, so that two vectors of the
threshold similarity meet in some table with probability ``recall``.

First buckets are counted by name only; vectors travel only to buckets that hold another one. A bucket is cut
into chunks of about ``chunk`` vectors and every pair of chunks is a task's work, so no bucket is ever held
whole. In a task cosines are one matrix product in double precision. A pair is counted in the first table in
which it meets and in no other, so numbers of links need no list of pairs; for components a task sends only a
spanning forest. Equal vectors are one vector with a count throughout.

Cases: a vector that is null, empty or zero, or holds null or non-finite components, links with nothing and
is kept; vectors of another length than most link only with their like. Repeated rows are copies. A null
vec_id takes part but names a component only if all are null. Empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import BASE, U, mix, settled
from rhoscope.llm.graph import components

WIDTH = 4.0


def meets(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at a distance fall into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float, crowd: int = 16) -> tuple[int, int]:
    """Depth and number of tables for n vectors."""
    near, far = meets(math.sqrt(2 - 2 * threshold)), meets(math.sqrt(2))
    depth = max(4, math.ceil(math.log(max(n / crowd, 2)) / -math.log(far)))
    return depth, math.ceil(math.log(1 - recall) / math.log1p(-(near**depth)))


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def buckets(units: np.ndarray, depth: int, tables: int, seed: int) -> np.ndarray:
    """A 64-bit bucket name for each vector and table."""
    rng = np.random.default_rng([seed, units.shape[1]])
    a, b = rng.standard_normal((units.shape[1], depth * tables)), rng.uniform(0, WIDTH, depth * tables)
    cells = np.floor((units @ a + b) / WIDTH).astype(np.int64).view(U).reshape(-1, tables, depth)
    h = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=U)), cells.shape[:2])
    for i in range(depth):
        h = mix(h * U(BASE) + cells[:, :, i])
    return h.view(np.int64)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as lists of equal length: values and row lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can have a cosine."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(vector).isNotNull()).filter(finite & F.exists(vector, lambda x: x != 0))


def link_embeddings(df: DataFrame, threshold: float = 0.95, recall: float = 0.975, chunk: int = 1024, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df`` (vec_id, embedding)."""
    rows = df.select("vec_id", "embedding")
    # Copies are one vector: a key of the group is its own 128-bit name.
    named = rows.withColumn("_vid", F.unhex(F.substring(F.sha2(F.to_json(F.struct(F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))).cast("binary"), 256), 1, 32)))
    good = settled(usable(named).groupBy("_vid").agg(F.min("vec_id").alias("low"), F.count("*").alias("times"), F.first("embedding").cast("array<double>").alias("vector")))
    n = good.count()
    depth, tables = plan(n, threshold, recall)

    def names(batches):
        for batch in batches:
            values, lengths = _matrix(batch.column("vector"))
            keys = np.zeros((len(lengths), tables), np.int64)
            ends = np.cumsum(lengths)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                keys[at] = buckets(unit(values[(ends[at] - d)[:, None] + np.arange(d)]), depth, tables, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())], names=[*batch.schema.names, "keys"])

    hashed = settled(good.select("_vid", "times", "vector").mapInArrow(names, "_vid binary, times long, vector array<double>, keys array<long>"))
    entries = hashed.select("_vid", F.posexplode("keys").alias("t", "key"))
    crowded = entries.groupBy("t", "key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("t").alias("_t"), F.col("key").alias("_key"), F.ceil(F.col("c") / chunk).cast("int").alias("chunks"))
    inside = entries.join(crowded, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_key"))).select("_vid", "t", "key", "chunks", F.pmod(F.xxhash64("_vid"), "chunks").cast("int").alias("chunk"))
    dealt = inside.select("_vid", "t", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("_vid", "t", "key", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))
    placed = dealt.join(hashed.withColumnRenamed("_vid", "_v"), F.col("_vid") == F.col("_v")).drop("_v")
    placed = placed.repartition("t", "key", "first", "second").sortWithinPartitions("t", "key", "first", "second")

    def linked(batches):
        for t, first, second, group in _groups(batches):
            vids, chunks = group["_vid"], np.array(group["chunk"])
            times, keys = np.array(group["times"], np.int64), np.array(group["keys"], np.int64)
            lengths = np.array([len(v) for v in group["vector"]])
            found, edges = np.zeros(len(vids), np.int64), []
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                units = unit(np.array([group["vector"][i] for i in at]))
                left, right = (np.flatnonzero(chunks[at] == c) for c in (first, second))
                if not left.size or not right.size:
                    continue
                near = units[left] @ units[right].T >= threshold
                if first == second:
                    near &= np.triu(np.ones(near.shape, bool), 1)
                i, j = np.nonzero(near)
                i, j = at[left[i]], at[right[j]]
                # Two blocks of keys at most chunk * chunk * t; most pairs meet in few tables.
                fresh = np.ones(i.size, bool)
                for e in range(t):
                    fresh &= keys[i, e] != keys[j, e]
                i, j = i[fresh], j[fresh]
                np.add.at(found, i, times[j])
                np.add.at(found, j, times[i])
                edges += _spanning(i.tolist(), j.tolist())
            out = [(vids[i], None, int(found[i])) for i in np.flatnonzero(found)] + [(vids[i], vids[j], None) for i, j in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "n"])

    found = settled(placed.mapInArrow(linked, "a binary, b binary, n long"))
    numbers = found.filter("n is not null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_n"))
    groups = components(found.filter("b is not null").select("a", "b"))
    texts = good.select("_vid", "low", "times").join(numbers, F.col("_vid") == F.col("_a"), "left").join(groups, F.col("_vid") == F.col("node"), "left")
    texts = settled(texts.select("_vid", "low", (F.col("times") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"), F.coalesce("component", "_vid").alias("component")))
    # Written first, so that Spark can split the join where a component is large.
    lows = settled(texts.groupBy(F.col("component").alias("_c")).agg(F.min("low").alias("component_id")))
    known = texts.join(lows, F.col("component") == F.col("_c")).select(F.col("_vid").alias("_k"), "n_links", "component_id")
    out = named.join(known, F.col("_vid") == F.col("_k"), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_k").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _groups(batches):
    """Rows of one bucket and pair of chunks at a time, from sorted batches."""
    open_, rows = None, None
    names = ("_vid", "chunk", "times", "keys", "vector")
    for batch in batches:
        heads = list(zip(*(batch.column(c).to_pylist() for c in ("t", "key", "first", "second")), strict=True))
        columns = [batch.column(c).to_pylist() for c in names]
        for i, head in enumerate(heads):
            if head != open_:
                if open_ is not None:
                    yield open_[0], open_[2], open_[3], rows
                open_, rows = head, {c: [] for c in names}
            for c, values in zip(names, columns, strict=True):
                rows[c].append(values[i])
    if open_ is not None:
        yield open_[0], open_[2], open_[3], rows


def _spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those pairs that join parts that weren't joined before."""
    root: dict[int, int] = {}
    kept = []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            kept.append((x, y))
    return kept
