"""From documents to a training mix: five stages, each one operator over all that its predecessor kept.

1. toxicity: documents that nearest labelled examples score as toxic go.
2. ngram_join: of each group of near copies (five-word shingles, similarity 0.8) the lowest doc_id stays.
3. decontamination: documents that hold a window of 13 words of a benchmark item go, and so do those of which a
   twentieth of the words, or more, are such items of fewer words.
4. secrets: secrets are replaced by their kind; no document goes.
5. mixing: how many words of which document the weighted mix takes; documents it takes nothing of go.

All stages but the last return the columns of documents, whatever they are. A stage's rows are written as
Parquet in the shared folder and read again, so a lost executor costs no earlier stage; that table goes once its
successor is written.

Cases: a null or empty text, or one without words, is neither toxic, a copy, contaminated nor secret; it has size 0, so
the mix takes nothing of it. A null source is a source of its own; a null doc_id always stays until the mix. Very
long texts are worked on whole. Repeated rows are copies; of rows with one text and one doc_id all stay, as each is
the lowest. Empty tables give empty results, and without labels or benchmark items nothing goes there. Further columns
stay as they are, whatever their names; the last stage returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscope.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from rhoscope.llm.common import discard, settled

_OWN = "_pipeline_"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels"), toxicity.fold() != 0, prefix=_OWN)
    return scored.filter(F.col(f"{_OWN}predicted") == 0).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), prefix=_OWN)
    return found.filter(~decontaminate.has_passage(prefix=_OWN)).select(*_columns(docs))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("mixing", mix_sources),
]

#: Nearest neighbours, components and decoded layers aren't for SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
