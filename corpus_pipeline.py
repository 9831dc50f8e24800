"""Corpus pipeline: language ID, exact dedup, near dedup, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftgrid.llm import exact_dedup, language, near_dedup, packing, repeats
from driftgrid.llm.common import delete, drop_finished_shuffles, lean_batches, written_tables
from driftgrid.plans.lineage import work_path


#: Tables that the stages so far have left in the shared folder.
_LEFT: list[str] = []


def _stage(spark: SparkSession, docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator(docs), after the tables of earlier stages are deleted.

    Their results have been written when the next stage begins, so nothing reads those tables any more; if docs
    still does, because a caller chains stages without writing, they stay. Batches to Python are kept
    small and a query's shuffle files go when it ends.
    """
    lean_batches(spark)
    drop_finished_shuffles(spark)
    files = docs.inputFiles() if _LEFT else []
    dead = [path for path in _LEFT if not any(f"/{path.rsplit('/', 1)[-1]}/" in file for file in files)]
    delete(spark, dead)
    _LEFT[:] = [path for path in _LEFT if path not in dead]
    with written_tables() as mine:
        out = operator(docs)
    _LEFT.extend(mine)
    return out


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with a probability of one half at least; the others go.

    Null and empty texts, and texts without a letter, have no language and go. Long texts are scored whole. Equal texts have equal
    scores, so repeated rows stay or go together. Columns pass unchanged, whatever their names; an empty table gives no rows.
    """
    return _stage(spark, docs, language.in_known_language)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    Null, empty and white texts are one group. The longest original text stays, ties by doc_id (null last), then by row, so of repeated
    rows one stays. Long texts are compared in widening ranges of bytes. Columns pass unchanged; an empty table gives no rows.
    """
    return _stage(spark, docs, exact_dedup.without_copies)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates.

    Null, empty and white texts have no words and all stay. The smallest doc_id of a class stays (null last); rows that repeat both
    id and text stay or go together. Long texts are sketched whole. Columns pass unchanged; an empty table gives no rows.
    """
    return _stage(spark, docs, near_dedup.without_near_copies)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 400 bytes and more that occur elsewhere too, and those of 50 words and more in other rows too.

    Null texts stay null; texts below both sizes stay as they are; repeated rows of 400 bytes and more lose their whole text, those of
    50 words and more all their words. Words are divided by ASCII white space. A character that a span cuts goes whole. n_chars follows the text; other columns pass unchanged. An empty table gives no rows.
    """
    return _stage(spark, docs, lambda d: repeats.without_repeats_text(d, words=50))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2,048 tokens.

    Null and empty texts are one end token. Long texts are cut into pieces of at most 2,048; repeated rows are packed like others.
    Only doc_id and text are read; an empty table gives no rows.
    """
    return _stage(spark, docs, lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", known_language), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("repeats", no_repeats), ("packing", packed)]

#: The language model, the alignment and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each result is written to the shared folder and read by the next stage.

    A stage's result is deleted when the next one is written; what stays is the last result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), work_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        delete(spark, [*_LEFT, *([before] if before else [])])
        _LEFT.clear()
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return docs
