"""A corpus pipeline: language ID, line dedup, near duplicates, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.

Defined cases, for every stage: columns that it doesn't know are carried
along unchanged, whatever their names (packing returns its own columns);
repeated rows are handled one by one (near-duplicate removal keeps all rows
of the document that stays); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import decontaminate, jaccard, langid, linededup, packing, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in. Null, empty and blank texts are in none and go; a null id or label is no reason to."""
    return langid.accept(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them; ``n_chars`` follows the text. A null text stays null; one whose every line recurs is ''."""
    return linededup.dedup_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the lowest id. Documents with a null id or text, or without words, stay."""
    return jaccard.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. Those with a null id or text stay; a null or wordless item matches none."""
    return decontaminate.drop_leaks(docs, store.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' token ids in packed sequences. A text without ids has a row of length 0 and no place."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Models, templates and alignments aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, store.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        store.drop(before)
    return docs
