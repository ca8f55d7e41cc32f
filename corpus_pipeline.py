"""A training-data pipeline: quality, exact copies, near copies, source mix, packing.

Each stage works on all that its predecessor kept, stored as Parquet in between. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences. The mix repeats documents, so an id can come twice
after it, and the packing then packs each of its rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioframe.llm.common import remove, stored, table
from folioframe.llm.exact_dedup import drop_exact_copies
from folioframe.llm.ngram_join import drop_near_copies
from folioframe.llm.packing import pack
from folioframe.llm.quality import drop_rejected
from folioframe.llm.source_mix import mixed_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of the training fold among ``docs``.

    Null and empty texts are scored like any other. Without a label 1 nothing is learned and all documents stay.
    """
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays; null and empty texts are equal, and null ids are the smallest."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more of their word 5-grams, one stays; texts without words are alike."""
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the sources' target weights draws them: never, once or twice, shard by shard.

    Null sources are one source. Texts without words are never drawn.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2,048 tokens; a null or empty text is one piece of one token."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("packing", packing)]

#: The stages learn, hash and draw, which SQL cannot express; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each one's rows stored before the next reads them.

    An empty table gives an empty result. A stage's rows are removed once the next stage's are stored; the last stage
    keeps the pieces in a checkpoint of its own, so the rows that it read can go as well.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, before)
    return out
