"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents with the columns
of ``documents``; the last adds ``copies``. Each result is written as Parquet and read again. SQL can express neither
the line field's verdict, edit matching nor the mix, so ORACLE_SQL is None and the tests use brute force.

Any stage takes empty tables, repeated rows (each is a row of its own, but near-dedup and the mix see rows alike in
doc_id and text as one), extra columns (they ride along, whatever their names) and nulls: a null text has no words, so the
quality rules reject it; a null doc_id is a document below all others for lines, is linked with nothing, and is mixed like
any other; a null source is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import table, written
from larkspur.llm.decontaminate import decontaminate
from larkspur.llm.lines import line_dedup
from larkspur.llm.mixing import mix_sources
from larkspur.llm.near import near_dedup
from larkspur.llm.quality import quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field keep. Null and empty texts go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that five or more hold (but for the largest doc_id); a text may become empty."""
    return line_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked at a similarity of 0.8 on five-word shingles; texts without words stay."""
    return near_dedup(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within 5 % of edits."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with how often the mix takes each (0 to 3)."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
