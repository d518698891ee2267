"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it decides takes
effect.  All but the last return the columns of ``documents``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corymb.llm import bytecnn, countjoin, hilbert, mixing, winnow
from corymb.llm.shared import fits, free_name, materialise

#: A document's language must be recognised with this probability at least.
LEAST_LANGUAGE_SCORE = 0.35
#: Rows of ids up to which a list of dropped documents is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _shielded(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` with columns of these names put aside, and their names back afterwards."""
    aside = {}
    for c in docs.columns:
        if c.lower() in names:
            aside[c] = free_name(docs, f"kept_{c}")
    out = work(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that is recognised; learns from the labelled ones.

    Null texts and texts without a letter go, as no language can be told.  Very long texts are read whole;
    repeated rows are judged alike and all stay or go.  Without a labelled document nothing can be learnt, and
    all documents stay.  An empty table gives none.  Columns named ``lang_pred`` or ``lang_score`` are kept as they are.
    """
    model = bytecnn.fit(docs)
    if model is None:
        return docs
    kept = lambda d: bytecnn.identify(d, model).where((F.col("lang_pred") != bytecnn.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return _shielded(docs, ("lang_pred", "lang_score"), kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones: the least by (id, hash of the text).

    Rows with one id are told apart by their texts; of rows that are equal in both, one stays.  Documents
    without words and rows with a null id link with nothing and stay.  An empty table gives none; other columns pass.
    """
    found = countjoin.jaccard_classes(docs).where("doc_id IS NOT NULL AND n_shingles > 0")
    found = materialise(found.select("doc_id", "th", ((F.col("doc_id") != F.col("component_id")) | (F.col("th") != F.col("component_th"))).alias("copy")), "copies", few=True)
    key, text = (free_name(docs, x) for x in ("cp_id", "cp_text"))
    keyed = docs.withColumns({key: F.col("doc_id"), text: countjoin.text_hash(F.col("text"))})
    small = lambda d: F.broadcast(d) if fits(d, BROADCAST_IDS) else d
    name = lambda d: d.select(F.col("doc_id").alias(key), F.col("th").alias(text))
    kept = keyed.join(small(name(found.where("copy").distinct())), [key, text], "left_anti")
    repeated = materialise(name(found.where("NOT copy").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")), "repeated", few=True)
    if repeated.limit(1).count():
        kept = kept.join(small(repeated), [key, text], "left_anti").unionByName(keyed.join(small(repeated), [key, text], "left_semi").dropDuplicates([key, text]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages to a twentieth of their words or more.

    Null and empty texts hold none and stay; null ids stay; repeated rows are judged alike; very long texts
    are read whole.  An empty table gives none, an empty benchmark drops none.  Columns named like the
    operator's (``n_words``, ``n_hit``, ``items``) are kept as they are.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _shielded(docs, tuple(winnow.ADDED.names), lambda d: winnow.decontaminate(d, benchmark).where(~winnow.contaminated()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until the sources have their target weights.

    A document comes as often as its ``repeats`` says; texts without words (null, empty) weigh nothing and
    are never taken.  A null source is a source of its own; rows that repeat count as often as they occur;
    ties in the seeded order go by size.  An empty table gives none.  Columns named like the operator's are
    kept as they are.
    """
    names = ("size", "source_size", "target", "taken", "repeats")
    mixed = lambda d: mixing.mix(d, mixing.word_count(F.col("text"))).where("repeats > 0").withColumn("repeats", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return _shielded(docs, names, mixed)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all documents to shards along a Hilbert curve over id, source, language and size.

    Every row gets a shard and a slot: null columns fall in the first class of their dimension, rows of one id
    stand in order of their texts' hashes, repeated rows get slots of their own.  An empty table gives none.
    Columns named ``shard`` or ``slot`` are replaced.
    """
    tie = free_name(docs, "hx_text")
    keyed = docs.withColumn(tie, countjoin.text_hash(F.col("text")))
    return hilbert.hilbert_shards(keyed, hilbert.document_dims(keyed), tie_cols=(tie,)).drop(tie)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("source_mixing", mixture),
    ("hilbert_sharding", sharding),
]

#: The network of the first stage can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
