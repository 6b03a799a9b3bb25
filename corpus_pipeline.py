"""From raw documents to packed training sequences: five stages over all rows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.labelled import training_rows
from tidewater.llm.packing import pack_documents
from tidewater.llm.pii import replace_personal_data
from tidewater.llm.quality_rules import keep_good
from tidewater.llm.shared import Scratch, table
from tidewater.llm.similar import similar_places
from tidewater.llm.simhash import keep_one
from tidewater.llm.toxicity import keep_civil, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    Null and empty texts go; very long ones are measured whole; repeated rows stay or go together; an empty table stays empty.
    """
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic window; the network learns from a bounded sample of labelled ones among them.

    Null and empty texts stay, having no window; very long ones are scored by all windows; repeated rows stay or go together.
    Null labels and labels of documents that are gone aren't learnt from.  No labels of one class: all scores are near the
    network's start.  An empty table stays empty.
    """
    return keep_civil(docs, train(training_rows(docs, table(spark, sf_dir, "labels"), "toxic", F.lit(True))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those linked by a similarity of 0.8 of their five-word shingles.

    Texts without words, null ones too, are one group.  The smallest doc_id stays, of equal ones the text with the smaller
    hash, of equal rows one; a null doc_id only where its group has no other.  Very long texts are compared by all their
    shingles.  An empty table stays empty.
    """
    return keep_one(docs, similar_places)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data.

    Null and empty texts and those without entities stay as they are; very long ones are searched whole; repeated rows and
    ties get the same text; an empty table stays empty.
    """
    return replace_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in their sequences.

    Null and empty texts are the end id alone; very long ones fill windows of their own; each of repeated rows is a document;
    an empty table has no piece.
    """
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("packing", packing)]

#: SQL can't express a trained network, nor a tokenizer; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each but the last written in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = Scratch.mark()
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.clear(mark)  # the stage's own tables; its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
