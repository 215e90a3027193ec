"""Quality by hierarchical empirical Bayes: a document's own evidence and posteriors of its host and path.

A logistic classifier on shape features (cases, signs, digits, repeated words and lines, lengths; each cut at
quantiles) is fitted on at most ``max_examples`` labelled documents, a documented bound. Its probabilities are
summed per path and per host by grouped aggregation over all documents. The spread of hosts around the whole,
and of paths around their hosts, beyond what sampling explains, gives the weights of two beta priors: a host's
posterior shrinks towards the global rate, a path's towards its host's, the more the fewer documents it has.
The score's log-odds are the document's plus those of its path posterior, less the global rate's; that posterior is
made from the site's other documents, so that a document's evidence counts once.

Hosts and paths are any columns: source and language for plain documents, ``site_of_url`` for pages.

A host with a third of all rows is one sum per task before the shuffle; joins bring posteriors back, one row
per path. Cases: a null or empty text has the features of an empty text; a null host or path is a site of its
own; null labels are not used, the largest of several counts; without labels of both kinds every document is
kept with the global rate; repeated rows are scored apart; empty tables give empty results; further columns
stay, but for clashing names, which the operator's own replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rhoscope.llm.common import runs, settled, texts_of, word_hashes
from rhoscope.llm.shared import HASHED_BYTES

CLASSES = {
    "upper": [(65, 90)],
    "digit": [(48, 57)],
    "sign": [(33, 47), (58, 64), (91, 96), (123, 126)],
    "space": [(9, 13), (32, 32)],
}
FEATURES = (*CLASSES, "size", "word", "distinct", "again", "lines", "top")
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    out = np.zeros((offsets.size - 1, len(FEATURES)))
    for i, j in runs(offsets, HASHED_BYTES):
        own, raw = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        size = np.maximum(np.diff(own), 1)
        for k, ranges in enumerate(CLASSES.values()):
            member = np.zeros(256, bool)
            for a, b in ranges:
                member[a : b + 1] = True
            sums = np.r_[0, np.cumsum(member[raw])]
            out[i:j, k] = (sums[own[1:]] - sums[own[:-1]]) / size
        words, first = word_hashes(raw, own)
        lines, line = word_hashes(raw, own, _LINES)
        for d in range(j - i):
            w, x = words[first[d] : first[d + 1]], lines[line[d] : line[d + 1]]
            if w.size:
                _, times = np.unique(w, return_counts=True)
                out[i + d, 4:] = np.log(size[d]), size[d] / w.size, times.size / w.size, (w[1:] == w[:-1]).mean() if w.size > 1 else 0, np.unique(x).size / x.size, times.max() / w.size
    return out


class Classifier:
    """Logistic regression on indicators of quantile bins, with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 12, ridge: float = 1.0):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        z = self.indicators(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + ridge * np.r_[0, w[1:]]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(w.size), grad)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def indicators(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for k, e in enumerate(self.edges):
            parts.append(np.eye(e.size + 1)[np.searchsorted(e, x[:, k], "right")])
        return np.concatenate(parts, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.indicators(x) @ self.weights, -12, 12)))


def fit(documents: DataFrame, labels: DataFrame, learn: Column, max_examples: int) -> Classifier | None:
    taken = labels.filter("doc_id is not null and quality is not null").filter(learn).groupBy("doc_id").agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # At most max_examples rows: a bound that doesn't grow with the data.
    chosen = documents.select("doc_id", "text").join(F.broadcast(taken.withColumnRenamed("doc_id", "_doc")), F.col("doc_id") == F.col("_doc")).select("_doc", "text", F.col("_quality").cast("int").alias("good"))

    def measured(batches):
        for batch in batches:
            x = features(*texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("good")], names=["x", "good"])

    # Of rows with one doc_id, the first text counts; so no more than max_examples rows come to the driver.
    rows = chosen.groupBy("_doc").agg(F.min("text").alias("text"), F.max("good").alias("good")).mapInArrow(measured, "x array<double>, good int").collect()
    rows = sorted((tuple(r["x"]), r["good"]) for r in rows)  # in one order, whatever the tasks' was
    y = np.array([g for _, g in rows], float)
    return Classifier(np.array([x for x, _ in rows]), y) if 0 < y.sum() < y.size else None


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host and first directory of a URL."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _prior_weight(groups: DataFrame, mean: str) -> float:
    """Weight, in documents, of the prior around ``mean`` for groups (n, p_sum), by their moments."""
    own = F.col("p_sum") / F.col("n")
    spread = F.col(mean) * (1 - F.col(mean))
    r = groups.filter("n > 1").agg(F.avg(F.pow(own - F.col(mean), 2)).alias("between"), F.avg(spread / F.col("n")).alias("chance"), F.avg(spread).alias("all")).first()
    if r["between"] is None or not r["all"]:
        return 100.0
    beyond = max(r["between"] - r["chance"], r["all"] / 10_000)
    return max(1.0, r["all"] / beyond - 1)


def score_quality(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, learn: Column | None = None, max_examples: int = 20_000, threshold: float = 0.5, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``documents`` with evidence, host_posterior, path_posterior, others_posterior (the path's without the
    document), score and kept (score >= ``threshold``).

    ``columns`` of the documents stay (None: all); what stays is written to the shared folder once.
    """
    own = ("evidence", "host_posterior", "path_posterior", "others_posterior", "score", "kept")
    keep = [c for c in (documents.columns if columns is None else columns) if c not in own]
    model = fit(documents, labels, F.lit(True) if learn is None else learn, max_examples)
    named = documents.select(*(f"`{c}`" for c in keep), F.col("text").alias("_text"), (F.col("source") if host is None else host).alias("_host"), (F.col("lang") if path is None else path).alias("_path"))

    def measured(batches):
        for batch in batches:
            p = model.probabilities(features(*texts_of(batch.column("_text")))) if model else np.full(batch.num_rows, 0.5)
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(p, pa.float64())], names=[*names, "evidence"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields if f.name != "_text")
    scored = settled(named.mapInArrow(measured, f"{shape}, evidence double"))
    paths = settled(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("evidence").alias("p_sum")))
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("n").alias("n"), F.sum("p_sum").alias("p_sum"))
    n, p_sum = paths.agg(F.sum("n"), F.sum("p_sum")).first()
    rate = p_sum / n if n else 0.5
    weight = _prior_weight(hosts.withColumn("mean", F.lit(rate)), "mean")
    posterior = lambda total, n, prior, mean: (total + prior * mean) / (n + prior)
    hosts = hosts.select("_h", F.col("n").alias("h_n"), F.col("p_sum").alias("h_sum"), posterior(F.col("p_sum"), F.col("n"), weight, rate).alias("host_posterior"))
    placed = settled(paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h"))
    inner = _prior_weight(placed, "host_posterior")
    about = ["n", "p_sum", "h_n", "h_sum", "host_posterior"]
    sites = placed.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), *(F.col(c).alias(f"_{c}") for c in about))
    joined = scored.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    # The site without this document; sums are rounded, so a lone document's rest may miss 0 by a hair.
    left = lambda c: F.greatest(F.col(c) - F.col("evidence"), F.lit(0.0))
    others = posterior(left("_p_sum"), F.col("_n") - 1, inner, posterior(left("_h_sum"), F.col("_h_n") - 1, weight, rate))
    joined = joined.withColumn("host_posterior", F.col("_host_posterior")).withColumn("path_posterior", posterior(F.col("_p_sum"), F.col("_n"), inner, F.col("_host_posterior"))).withColumn("others_posterior", others)
    odds = logit(F.col("evidence")) + logit(F.col("others_posterior")) - logit(F.lit(rate))
    joined = joined.withColumn("score", F.lit(rate) if model is None else 1 / (1 + F.exp(-odds)))
    kept = F.lit(True) if model is None else F.col("score") >= threshold
    return joined.select(*(f"`{c}`" for c in keep), "evidence", "host_posterior", "path_posterior", "others_posterior", "score", kept.alias("kept"))
