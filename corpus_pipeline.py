"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of documents. A stage removes the scratch tables of the stage before
it, whose result has been written by then, and no others.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salescope.llm import minhash, mixing, packing, secrets
from salescope.llm import toxicity as toxic
from salescope.llm.common import release_scratch, remove, scratch_tables, shared_dir
from salescope.llm.queries import tokenizer_path


#: Least common share of two documents' five-word shingles; op2 itself keeps its 85.
NEAR_PERCENT = 80


#: Scratch tables of the latest stage of each application.
_LATEST: dict[str, list[str]] = {}


def _release_latest(spark: SparkSession) -> None:
    release_scratch(spark, _LATEST.pop(spark.sparkContext.applicationId, []))


def stage(function: Callable) -> Callable:
    """``function`` after the scratch tables of the stage before it are removed."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release_latest(spark)
        others = set(scratch_tables(spark))
        out = function(spark, docs, sf_dir)
        _LATEST[spark.sparkContext.applicationId] = [t for t in scratch_tables(spark) if t not in others]
        return out

    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labels, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.without_toxic(docs, toxic.train(docs, labels))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked at Jaccard 0.8 and above, stays."""
    return minhash.deduplicated(docs, percent=NEAR_PERCENT)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut at each source's budget."""
    return mixing.mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Learning, MinHash and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is read from its written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, function) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    _release_latest(spark)
    return docs
