"""N-gram Jaccard join: prefixes of single rare shingles and of combinations of frequent ones.

Shingles are ordered by the number of texts that hold them, rarest first. Two sets whose Jaccard similarity
reaches the threshold t share at least 1 + m members among the first n - ceil(t n) + 1 + m of each. Rare
shingles index a text singly. Frequent ones (in more than ``frequent`` texts) fall by hash into m groups and
index it in pairs of one group: of 1 + m shared members either one is rare or two fall into one group.
m follows the size of the set (a power of two near n / 16), so pairs stay in proportion to the prefix; a text
near a border of sizes is indexed for both. Where 1 + m is more than two sets must share (sets of one shingle,
at low thresholds larger ones), the whole set indexes the text singly as well. A shingle of one text only takes
its place in the prefix but indexes nothing. Texts with one index entry in common are candidates unless their
sizes, the places of the common shingle, or their parities rule the threshold out; candidates are verified on
their shared shingles. Parities are 256 bits of a set, each flipped once per shingle that falls on it: two sets
differ in at least as many shingles as bits.

Only components are wanted, so a group of thousands of copies needs no pairs among all of them. First every
index entry's most central text is verified against its other texts; most entries then lie in one component.
Then every text outside an entry's largest component is verified against the entry's texts of other
components. Every pair of different components that shares an entry is thus verified, and no link between
components is lost. Exact copies of a text are one text throughout.

Cases: a null or empty text, or one without words, has an empty set and links with nothing; with fewer words
than a shingle, the whole sequence is one shingle. Repeated rows are copies. A null doc_id takes part but is
never a component's name unless all are null. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import BASE, U, discard, mix, settled, shingles, word_hashes
from rhoscope.llm.graph import components
from rhoscope.llm.shared import shared_keys, text_classes


def level(n: int) -> int:
    """log2 of the number of groups that frequent shingles fall into, for a set of n."""
    return max(0, (n // 16).bit_length() - 1)


def index_entries(n: int, keys: np.ndarray, counts: np.ndarray, percent: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set of n, and the place of each one's first shingle among the shared ``keys``."""
    least, most = -(-percent * n // 100), 100 * n // percent
    if most == n:  # only equal sets can reach the threshold, and one text's copies are one text
        least = n
    alone = n - keys.size
    entries, places = [], []
    levels = range(level(least), level(most) + 1)
    reach = lambda m: max(0, min(n, n - least + 1 + m) - alone)
    prefix = keys[: reach(1 << levels[-1])]
    rare = int(np.searchsorted(counts[: prefix.size], frequent, "right"))
    # Partners may share fewer than 1 + m; then prefix is all of keys, and the common one may be frequent.
    singly = rare if 1 + (1 << levels[-1]) <= least else prefix.size
    if singly:
        entries.append(mix(prefix[:singly]))
        places.append(np.arange(singly))
    for at in levels:
        prefix = keys[: reach(1 << at)]
        if prefix.size - rare < 2:
            continue
        group = mix(prefix[rare:] ^ U(BASE)) & U((1 << at) - 1)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(group[order].astype(np.int64)) != 0, True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            member = np.sort(order[a:b]) + rare
            i, j = np.triu_indices(member.size, 1)
            entries.append(mix(mix(prefix[member[i]] * U(BASE) + prefix[member[j]]) + U(at + 1)))
            places.append(member[i])
    if not entries:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(entries), np.concatenate(places)


PARITIES = [f"p{i}" for i in range(4)]


def parities(keys: np.ndarray) -> list[int]:
    """256 bits in four signed numbers: is the number of keys that fall on a bit odd?"""
    odd = np.bincount((mix(keys) >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _can_link(percent: int) -> Column:
    """From sizes n, numbers e of shared shingles, their parities, and the common shingle's places r among them."""
    differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_2"))) for p in PARITIES), F.lit(0))
    most = F.least(F.least("r", "r2") + F.least(F.col("e") - F.col("r"), F.col("e2") - F.col("r2")), F.floor((F.col("e") + F.col("e2") - differ) / 2))
    return (100 * most >= percent * (F.col("n") + F.col("n2") - most)) & (100 * F.col("n") >= percent * F.col("n2")) & (100 * F.col("n2") >= percent * F.col("n"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose Jaccard similarity reaches the threshold."""

    def work(batches):
        for batch in batches:
            a, b, m, n, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "m", "n", "x", "y"))
            keep = []
            for i in range(batch.num_rows):
                common = np.intersect1d(wide(x[i]), wide(y[i]), assume_unique=True).size
                if 100 * common >= percent * (m[i] + n[i] - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], names=["a", "b"])

    left = sets.select(F.col("tid").alias("a"), F.col("n").alias("m"), F.col("keys").alias("x"))
    right = sets.select(F.col("tid").alias("b"), "n", F.col("keys").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(work, "a binary, b binary")


def narrow(keys: np.ndarray) -> bytes:
    """48-bit keys in six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def wide(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def indexed_texts(documents: DataFrame, total_bytes: int, size: int, percent: int, frequent: int, **sizes_of_work: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames: (tid, n) of every text with words; index entries that several texts have, with what
    _can_link needs of each text; and (tid, n, keys) of those texts, keys being their shared shingles."""

    def keys_of(offsets, data):
        words, first = word_hashes(data, offsets)
        return [shingles(words[first[i] : first[i + 1]], size) for i in range(offsets.size - 1)]

    def finish(n, keys, counts):
        entries, places = index_entries(n, keys, counts, percent, frequent) if keys.size else (np.zeros(0, U), None)
        if not entries.size:
            return n, keys.size, None, None, None, None
        return n, keys.size, narrow(np.sort(keys)), parities(keys), entries.view(np.int64), places.astype(np.int32)

    fields = [("n", pa.int64(), "long"), ("e", pa.int64(), "long"), ("keys", pa.binary(), "binary"), ("bits", pa.list_(pa.int64()), "array<long>"), ("entries", pa.list_(pa.int64()), "array<long>"), ("places", pa.list_(pa.int32()), "array<int>")]
    found = settled(shared_keys(documents, total_bytes // 6 + 1, keys_of, finish, fields, **sizes_of_work))
    sizes = settled(found.groupBy("tid").agg(F.max("n").alias("n")))
    # A text may come from several blocks; its entries are the same each time.
    entries = found.filter("entries is not null").select("tid", "n", "e", *(F.col("bits")[i].alias(p) for i, p in enumerate(PARITIES)), F.explode(F.arrays_zip("entries", "places")).alias("z"))
    exploded = entries.select(F.col("z.entries").alias("entry"), "tid", "n", "e", F.col("z.places").alias("r"), *PARITIES)
    several = exploded.groupBy("entry").agg(F.min("tid").alias("_low"), F.max("tid").alias("_high")).filter("_low <> _high").select(F.col("entry").alias("_entry"))
    index = settled(exploded.join(several, F.col("entry") == F.col("_entry")).drop("_entry").dropDuplicates(["entry", "tid"]))
    used = index.select(F.col("tid").alias("_tid")).distinct()
    sets = settled(found.filter("keys is not null").select("tid", "n", "keys").join(used, F.col("tid") == F.col("_tid"), "left_semi").dropDuplicates(["tid"]))
    discard(found)
    return sizes, index, sets


ABOUT = ["n", "e", "r", *PARITIES]


def _second(c: str) -> Column:
    """A column of the other text of a pair."""
    return F.col(c).alias({"entry": "entry2", "tid": "tid2", **{p: f"{p}_2" for p in PARITIES}}.get(c, f"{c}2"))


def linked_texts(documents: DataFrame, total_bytes: int, size: int, percent: int, frequent: int, **sizes_of_work: int) -> tuple[DataFrame, DataFrame]:
    """(tid, n) of every text with words, and (tid, component) of those that link with another text."""
    sizes, index, sets = indexed_texts(documents, total_bytes, size, percent, frequent, **sizes_of_work)
    central = index.groupBy("entry").agg(F.max_by(F.struct("entry", "tid", *ABOUT), F.struct(F.col("e") / F.col("n"), "n", "tid")).alias("c")).select("c.*").select(*map(_second, ("entry", "tid", *ABOUT)))
    stars = index.join(central, (F.col("entry") == F.col("entry2")) & (F.col("tid") != F.col("tid2")) & _can_link(percent))
    pairs = settled(stars.select(*_ordered("tid", "tid2")).distinct())
    links = settled(_verified(pairs, sets, percent))
    found_so_far = components(links)
    discard(pairs)
    placed = index.join(found_so_far, F.col("tid") == F.col("node"), "left").select("entry", "tid", *ABOUT, F.coalesce("component", "tid").alias("component"))
    mixed = placed.groupBy("entry", "component").agg(F.count("*").alias("c")).groupBy("entry").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k")).filter("k > 1").select(F.col("entry").alias("_entry"), "main")
    open_ = settled(placed.join(mixed, F.col("entry") == F.col("_entry")).drop("_entry"))
    others = open_.select(*map(_second, ("entry", "tid", *ABOUT, "component")))
    rest = open_.filter("component <> main").join(others, (F.col("entry") == F.col("entry2")) & (F.col("component") != F.col("component2")) & _can_link(percent))
    pairs = settled(rest.select(*_ordered("tid", "tid2")).distinct())
    more = settled(_verified(pairs, sets, percent))
    discard(pairs, open_, index, sets)
    joined = components(links.unionAll(more)) if more.take(1) else found_so_far
    return sizes, joined.select(F.col("node").alias("tid"), "component")


def similar_pairs(documents: DataFrame, size: int = 5, percent: int = 80, frequent: int = 64, **sizes_of_work: int) -> tuple[DataFrame, DataFrame]:
    """The join itself: (tid, tid2) of all links between different texts, and (doc_id, tid), who has which text.

    A group of n near copies has up to n^2 / 2 links, and they are all here; join_ngrams needs far fewer.
    """
    classes = text_classes(documents.select("doc_id", "text"))
    total = classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    _, index, sets = indexed_texts(documents.select("text"), total, size, percent, frequent, **sizes_of_work)
    others = index.select(*map(_second, ("entry", "tid", *ABOUT)))
    pairs = index.join(others, (F.col("entry") == F.col("entry2")) & (F.col("tid") < F.col("tid2")) & _can_link(percent)).select(F.col("tid").alias("a"), F.col("tid2").alias("b")).distinct()
    return settled(_verified(settled(pairs), sets, percent)).select(F.col("a").alias("tid"), F.col("b").alias("tid2")), classes.select("doc_id", "tid")


def join_ngrams(documents: DataFrame, size: int = 5, percent: int = 80, frequent: int = 64, **sizes_of_work: int) -> DataFrame:
    """(doc_id, tid, n_shingles, component_id) of every row; links are Jaccard similarities of ``percent`` or more.

    ``sizes_of_work``: slice_bytes and part_keys of shared_keys, for executors with more memory.
    """
    classes = text_classes(documents.select("doc_id", "text"))
    total = classes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    sizes, linked = linked_texts(documents.select("text"), total, size, percent, frequent, **sizes_of_work)
    lowest = classes.groupBy("tid").agg(F.min("doc_id").alias("low"))
    texts = lowest.join(sizes.withColumnRenamed("tid", "_t"), F.col("tid") == F.col("_t"), "left").drop("_t").join(linked.withColumnRenamed("tid", "_t"), F.col("tid") == F.col("_t"), "left").drop("_t")
    texts = settled(texts.select("tid", "low", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "tid").alias("component")))
    # Written first, so that Spark can split the join where a component is large.
    named = settled(texts.groupBy(F.col("component").alias("_c")).agg(F.min("low").alias("component_id")))
    texts = texts.join(named, F.col("component") == F.col("_c")).select(F.col("tid").alias("_t"), F.col("n").alias("n_shingles"), "component_id")
    # Texts without words link with nothing, copies or not.
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return classes.join(texts, F.col("tid") == F.col("_t")).select("doc_id", "tid", "n_shingles", component.alias("component_id"))


def one_of_each(documents: DataFrame, **options) -> DataFrame:
    """``documents`` with only the lowest doc_id of each component; rows without words or doc_id all stay."""
    kept = join_ngrams(documents, **options).filter("n_shingles > 0 and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_doc")).distinct()
    return documents.join(kept, F.col("doc_id") == F.col("_doc"), "left_anti")
