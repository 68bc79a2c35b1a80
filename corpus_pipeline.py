"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality classifier, line dedup, SimHash near-dedup, mixing of sources, BPE. Every stage takes
``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but the last
return the columns of ``documents``. SQL cannot express the classifier, so ``ORACLE_SQL`` is None;
the stages are tested against plain Python versions of each (``tests/llm/test_pipeline.py``).

Defined cases, for every stage: a null text counts as empty, and is kept only where an empty one is;
rows that repeat an id or a whole row are rows of their own until the near-copy stage, which keeps
one row of each component; null ids, nulls in other columns, and columns beside those of
``documents`` pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelflow.llm import bpe, lines, mixing, quality, simhash
from panelflow.llm.common import stored, table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated and nearly repeated lines; documents that lose every line go."""
    return lines.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, repeated as often as their epochs read them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
