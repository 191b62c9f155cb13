"""The corpus pipeline: filter, deduplicate, decontaminate and mix ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
what it returns is written as Parquet and read again for the next one.

Null text counts as empty and leaves the first stage so; very long texts are taken whole.
Rows without an id are scored and mixed like others; the stages that compare documents
leave them as they are. Rows that repeat an id go or stay together, but for the first
stage, which scores each. Other columns pass through, whatever their names. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratelens.llm.decontaminate import decontaminated
from ratelens.llm.line_dedup import line_dedup
from ratelens.llm.minhash_dedup import near_duplicates
from ratelens.llm.mixing import mixed
from ratelens.llm.quality import fit, score
from ratelens.llm.tables import restored, table, without
from ratelens.session import cut_lineage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents among ``docs``; those scored below 0.5 go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(spark, docs, model, keep_text=True).where("score >= 0.5")
    return restored(scored, docs, text=F.col("text"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of lines from the texts: three or more lines, 50 or more
    words, or whole documents; ``n_chars`` follows. Documents of which no line is left go."""
    found = line_dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    return restored(found, docs, text=F.col("kept"), n_chars=F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select("row.doc_id")
    return without(docs, cut_lineage(gone.distinct(), "near-duplicates"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix: sources by the root of their sizes. The
    columns ``mix_block``, ``mix_slot`` and ``mix_place`` take the place of columns of
    these names that ``docs`` already has."""
    others = (F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("mix_block", "mix_slot", "mix_place"))
    return mixed(docs).select(*others, F.col("block").alias("mix_block"), F.col("slot").alias("mix_slot"), F.col("place").alias("mix_place"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
