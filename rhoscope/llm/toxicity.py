"""Toxicity by the nearest labelled examples: exact cosines over a block-max inverted index of all their words.

Fitting takes at most ``max_examples`` labelled documents (lowest hash of doc_id first, a documented bound; equal
texts count once, by the label that most of them have, or else the lowest doc_id's). Every word of an example is a
term, by its 64-bit hash, however rare and whatever its labels, so neighbours are searched for every text that has a
word in common with an example. A term weighs TF-IDF times 1 + r^2, r being the logarithm by which it changes the
odds of the label, pulled towards 0 as if seen in 4 more documents at the common rate.

Examples lie in blocks of ``BLOCK``, those with one most frequent word and about as many words side by side. The index
holds each term's list of examples and, for common terms, its largest weight in every block. A query's cosines with
a block's examples can't exceed the block's bound: the largest sum of the rare terms' shares that one of its examples
has, plus the common terms' largest weights. The blocks of highest bound are searched first; after that, only blocks
whose bound reaches the k-th similarity found. What comes near the k-th is summed again in full precision, so the k
nearest are exact. Votes are weighed by squared similarity and pulled towards the base rate; a logistic curve fitted
on leave-one-out votes calibrates them. A text without terms is equally far from every example; its score is the
toxic rate of such examples.

Cases: null or empty texts score as texts without terms. Labels that are null are not used; a document with
several labels is toxic if one is. Without any label the score is 0. Repeated rows are scored apart; further
columns stay in ``score_toxicity`` where they don't clash with its own, which replace them.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import discard, runs, settled, texts_of, trim, word_hashes
from rhoscope.llm.shared import HASHED_BYTES

LETTERS = re.compile(r"[^\W\d_]+")


def normal(text: str | None) -> str:
    """Lower-case words of letters, one space between and around."""
    return f" {' '.join(LETTERS.findall(text.lower()))} " if text else " "


def words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every text the sorted hashes of its words, and how often each occurs."""
    offsets, data = texts_of(pa.array([normal(t) for t in texts], pa.large_string()))
    for a, b in runs(offsets, HASHED_BYTES):
        hashes, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            yield np.unique(hashes[first[i] : first[i + 1]], return_counts=True)


def kind_of(t: np.ndarray, n: np.ndarray) -> tuple[int, int]:
    """Most frequent term and number of terms: what texts that lie side by side have in common."""
    return (int(t[np.argmax(n)]), t.size) if t.size else (-1, 0)


class Index:
    """Examples as inverted lists; the k nearest by cosine, exactly. ``batch`` queries are searched at once.

    An example is (name, label, counts by term); counts are a dict or two arrays, terms ascending.
    """

    #: As many of the commonest terms, at most, have a weight for every example and a bound for every block.
    DENSE = 256
    #: Examples of a block.
    BLOCK = 16

    def __init__(self, idf, examples: list[tuple[object, int, object]], base: float, k: int = 15, batch: int = 64, prior: float = 1.0, without: float | None = None):
        self.idf, self.base, self.k, self.batch, self.prior = np.array(idf, float), base, k, batch, prior
        self.without = base if without is None else without
        self.curve = (1.0, 0.0)
        rows = [(name, toxic, *self.arrays(tf)) for name, toxic, tf in examples]
        rows.sort(key=lambda r: (*kind_of(r[2], r[3]), str(r[0]), r[1], zlib.crc32(r[2]), zlib.crc32(r[3])))
        self.ids, self.toxic = [r[0] for r in rows], np.array([r[1] for r in rows], float)
        # Of equally near examples the one whose name comes first is taken.
        self.rank = np.empty(len(rows), np.int32)
        self.rank[sorted(range(len(rows)), key=lambda i: (str(rows[i][0]), i))] = np.arange(len(rows))
        terms = np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows)])
        counts = np.concatenate([np.zeros(0, np.int32), *(r[3] for r in rows)])
        order = np.argsort(terms, kind="stable")
        self.edges = np.r_[0, np.cumsum(np.bincount(terms, minlength=self.idf.size))]
        self.at = np.repeat(np.arange(len(rows), dtype=np.int32), [r[2].size for r in rows])[order]
        self.counts = counts[order].astype(np.min_scalar_type(counts.max(initial=0)))
        del terms, counts, order
        self.weigh()
        self.calibrate([(r[2], r[3]) for r in rows])

    @staticmethod
    def arrays(tf) -> tuple[np.ndarray, np.ndarray]:
        t, n = (sorted(tf), [tf[t] for t in sorted(tf)]) if isinstance(tf, dict) else tf
        return np.asarray(t, np.int32), np.asarray(n, np.int32)

    def weigh(self) -> None:
        """What follows from the counts: weights in the lists, and the common terms' by example and by block."""
        sizes, n = np.diff(self.edges), len(self.ids)
        self.weight = np.log(self.counts, dtype=float)
        self.weight += 1
        self.weight *= np.repeat(self.idf, sizes)
        self.weight /= np.sqrt(np.bincount(self.at, self.weight * self.weight, n))[self.at]
        common = np.argsort(-sizes, kind="stable")[: self.DENSE]
        common = np.sort(common[sizes[common] > n // 32])
        self.slot = np.full(sizes.size, -1, np.int32)
        self.slot[common] = np.arange(common.size)
        self.blocks = -(-n // self.BLOCK)
        matrix = np.zeros((self.blocks * self.BLOCK, common.size))
        for i, t in enumerate(common):
            a, z = self.edges[t], self.edges[t + 1]
            matrix[self.at[a:z], i] = self.weight[a:z]
        self.matrix = matrix
        self.rough = matrix.astype(np.float32).reshape(self.blocks, self.BLOCK, common.size)
        self.most = np.ascontiguousarray(self.rough.max(1).T) if n else np.zeros((common.size, 0), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("weight", "slot", "matrix", "rough", "most")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.weigh()

    def weights(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[t]
        return w / math.sqrt(w @ w)

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        t, n = self.arrays(tf)
        return dict(zip(t.tolist(), self.weights(t, n).tolist(), strict=True))

    def nearest(self, v: dict[int, float], without: int = -1) -> list[tuple[float, int]]:
        t = np.array(sorted(v), np.int64)
        return next(self.search([(t, np.array([v[i] for i in t.tolist()]))], [without]))

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[list[tuple[float, int]]]:
        """For every query, (similarity, example) by falling similarity, then name; similarity 0 isn't near."""
        for first in range(0, len(queries), self.batch):
            yield from self.batch_of(queries[first : first + self.batch], without[first : first + self.batch] if without else None)

    def batch_of(self, some: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None) -> Iterator[list[tuple[float, int]]]:
        many, size = len(some), self.blocks * self.BLOCK
        left, rare = np.zeros((many, self.most.shape[0]), np.float32), np.empty((many, size))
        parts = []
        for i, (t, w) in enumerate(some):
            slots = self.slot[t]
            dense = slots >= 0
            left[i, slots[dense]] = w[dense]
            parts.append((slots[dense], w[dense]))
            t, w = t[~dense], w[~dense]
            sizes = self.edges[t + 1] - self.edges[t]
            at = np.repeat(self.edges[t] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            rare[i] = np.bincount(self.at[at], np.repeat(w, sizes) * self.weight[at], size)
        by_block = rare.reshape(many, self.blocks, self.BLOCK)
        bound = left @ self.most + by_block.max(2)
        # What the best blocks hold gives a similarity that the k-th nearest reaches at least; one may be left out.
        tried = min(self.blocks, 2 + -(-self.k // self.BLOCK))
        best = np.argpartition(-bound, tried - 1, axis=1)[:, :tried]
        found = np.matmul(self.rough[best].reshape(many, tried * self.BLOCK, -1), left[:, :, None])[:, :, 0] + by_block[np.arange(many)[:, None], best].reshape(many, -1)
        k = self.k + (without is not None)
        least = np.partition(found, found.shape[1] - k, axis=1)[:, -k] if found.shape[1] >= k else np.zeros(many)
        held = (bound > 0) & (bound >= least[:, None] - 1e-5)
        open_ = np.flatnonzero(held.any(0))
        places = (open_[:, None] * self.BLOCK + np.arange(self.BLOCK)).ravel()
        scores = (left @ self.rough[open_].reshape(places.size, -1).T) + rare[:, places]
        for i, (slots, w) in enumerate(parts):
            mine = scores[i]
            if without is not None and without[i] >= 0:
                mine[places == without[i]] = 0
            near = np.flatnonzero((mine > 0) & (mine >= (np.partition(mine, mine.size - self.k)[-self.k] - 1e-5 if mine.size > self.k else 0.0)))
            near = places[near]
            # Added up term by term, so that a sum doesn't depend on what else is summed.
            exact = np.round(rare[i, near] + (w[:, None] * self.matrix[near[None], slots[:, None]]).sum(axis=0), 12)
            order = np.lexsort((self.rank[near], -exact))[: self.k]
            yield list(zip(exact[order].tolist(), near[order].tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = np.array([s * s for s, _ in near])
        return float((weights @ self.toxic[[i for _, i in near]] if near else 0.0) + self.prior * self.base) / float(weights.sum() + self.prior)

    def calibrate(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Fit a logistic curve to leave-one-out votes; a weak pull keeps it near the identity."""
        if not len(self.toxic):
            return
        x = []
        for first in range(0, len(counts), 512):
            some = [(t, self.weights(t, n)) for t, n in counts[first : first + 512]]
            x += [logit(self.vote(near)) for near in self.search(some, list(range(first, first + len(some))))]
        x = np.array(x)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(p - self.toxic) @ x + 4 * (a - 1), (p - self.toxic).sum() + 4 * b])
            w = p * (1 - p)
            step = np.linalg.solve(np.array([[w @ (x * x) + 4, w @ x], [w @ x, w.sum() + 4]]), g)
            a, b = a - step[0], b - step[1]
        if a > 0 and math.isfinite(a) and math.isfinite(b):
            self.curve = (a, b)

    def score(self, tfs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        # Queries of one kind are searched together, as they need the same blocks.
        order = sorted((i for i, (t, _) in enumerate(tfs) if t.size), key=lambda i: kind_of(*tfs[i]))
        nearest = dict(zip(order, self.search([(tfs[i][0], self.weights(*tfs[i])) for i in order]), strict=True))
        return [(1 / (1 + math.exp(-(self.curve[0] * logit(self.vote(nearest[i])) + self.curve[1]))), nearest[i]) if i in nearest else (self.without, []) for i in range(len(tfs))]


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fitted(documents: DataFrame, labels: DataFrame, learn: Column, max_examples: int = 12_000) -> bytes:
    """What ``fit`` gives, packed. Learned from labelled documents for which ``learn`` (a Column on doc_id) holds."""
    taken = labels.filter("doc_id is not null and toxic is not null").filter(learn).groupBy("doc_id").agg(F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # At most max_examples rows: a bound that doesn't grow with the data.
    chosen = documents.select("doc_id", "text").join(F.broadcast(taken.withColumnRenamed("doc_id", "_doc")), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", F.col("_toxic").cast("int").alias("toxic"))

    kind = documents.schema["doc_id"].dataType.simpleString()
    bad, good = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    label = F.when(bad > good, 1).when(bad < good, 0).otherwise(F.min_by("toxic", "doc_id"))
    sample = chosen.groupBy("text").agg(F.min("doc_id").alias("doc_id"), label.alias("toxic")).select("doc_id", "text", "toxic")

    def vectors(batches):
        for batch in batches:
            words = [(h.tobytes(), n.astype(np.int32).tobytes()) for h, n in words_of(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array([w[i] for w in words], pa.binary()) for i in range(2))], names=["doc_id", "toxic", "words", "counts"])
        trim()

    def built(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        hashes = [np.frombuffer(r["words"], np.uint64) for r in rows]
        words = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        examples, none, none_bad, n, toxic = [], 0, 0, len(rows), sum(r["toxic"] for r in rows)
        seen, bad = (np.zeros(words.size, np.int64) for _ in range(2))
        for r, h in zip(rows, hashes, strict=True):
            t = np.searchsorted(words, h).astype(np.int32)
            seen[t] += 1
            bad[t] += r["toxic"]
            if t.size:
                examples.append((r["doc_id"], r["toxic"], (t, np.frombuffer(r["counts"], np.int32))))
            else:
                none, none_bad = none + 1, none_bad + r["toxic"]
        if not n:
            index = None
        else:
            p, rate = toxic / n, (toxic + 0.5) / (n + 1)
            change = np.log((bad + 4 * rate) / (seen - bad + 4 * (1 - rate))) - logit(rate)
            index = Index((np.log((n + 1) / (seen + 1)) + 1) * (1 + change**2), examples, p, without=(none_bad + p) / (none + 1))
        # With the class in them, as executors may lack this package.
        model = zlib.compress(cloudpickle.dumps((words, index)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])
        trim()

    # At most max_examples rows go to one executor, so that the driver holds the finished model alone.
    found = settled(sample.mapInArrow(vectors, f"doc_id {kind}, toxic int, words binary, counts binary"))
    model = found.repartition(1).mapInArrow(built, "model binary").first()
    discard(found)
    return bytes(model[0]) if model else zlib.compress(pickle.dumps((np.zeros(0, np.uint64), None)))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, **limits) -> tuple[np.ndarray, Index | None]:
    """Hashes of words, and the index of the examples."""
    return pickle.loads(zlib.decompress(fitted(documents, labels, learn, **limits)))


def score_toxicity(documents: DataFrame, labels: DataFrame, learn: Column | None = None, prefix: str = "", **limits) -> DataFrame:
    """``documents`` with score, predicted (score >= 0.5), and evidence: the nearest examples.

    ``prefix`` goes before the names of these columns.
    """
    packed = fitted(documents, labels, F.lit(True) if learn is None else learn, **limits)
    model = documents.sparkSession.sparkContext.broadcast(packed)
    del packed
    own = [f"{prefix}{c}" for c in ("score", "predicted", "evidence")]
    kept = [f for f in documents.schema.fields if f.name not in own]

    def work(batches):
        words, index = pickle.loads(zlib.decompress(model.value))
        shown = pa.array([str(i) for i in index.ids] if index else [], pa.string())
        toxic = pa.array(index.toxic.astype(np.int32) if index else [], pa.int32())

        def query(hashes, n):
            at = np.searchsorted(words, hashes)
            known = np.flatnonzero(at < words.size)
            known = known[words[at[known]] == hashes[known]]
            return at[known], n[known]

        for batch in batches:
            trim()
            # Some texts at a time: what a query holds grows with its words.
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                queries = [query(*w) for w in words_of(part.column("text").to_pylist())] if index else []
                # Texts with the same counts are searched once.
                keys = [(t.tobytes(), n.tobytes()) for t, n in queries]
                own_key = dict(zip(keys, queries, strict=True))
                known = dict(zip(own_key, index.score(list(own_key.values())), strict=True)) if index else {}
                scored = [known[k] for k in keys] if index else [(0.0, [])] * part.num_rows
                scores = [score for score, _ in scored]
                near = [x for _, e in scored for x in e]
                places = pa.array([i for _, i in near], pa.int64())
                structs = pa.StructArray.from_arrays([shown.take(places), pa.array([x for x, _ in near], pa.float64()), toxic.take(places)], names=["doc_id", "similarity", "toxic"])
                evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(e) for _, e in scored)]), pa.int32()), structs)
                columns = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), evidence], names=[*(f.name for f in kept), *own])

    kinds = ("double", "int", "array<struct<doc_id:string,similarity:double,toxic:int>>")
    shape = ", ".join(f"`{n}` {k}" for n, k in [*((f.name, f.dataType.simpleString()) for f in kept), *zip(own, kinds, strict=True)])
    return documents.select(*(f"`{f.name}`" for f in kept)).mapInArrow(work, shape)


def fold(doc_id: str = "doc_id", n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
