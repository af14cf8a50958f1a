"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, personal data, mixing.

run() applies the stages to documents, each to the whole written result of the one before. The first four return the
columns of documents; the last adds size, source_size, target and taken, for documents that the mix takes words of.

Nulls and empty texts have no words, so the first stage rejects them; so it does tables' rows without a text, and a null
id or source stays a value of its own. Texts are read whole, however long. Repeated rows and equal texts are one group of
the second stage, of which the smallest id stays. Empty tables give empty results. Columns beyond those of documents pass
through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorweft.llm import decontam, mixing, pii, quality, simhash
from tensorweft.llm.common import materialise, quoted, table

#: zstandard ratios, XXH64 fingerprints and components aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None

#: Near duplicates share this much of their sets of SHINGLE-word runs.
SHINGLE, SIMILARITY = 5, 0.8


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.quality(docs.withColumn("_all", F.struct(*map(quoted, docs.columns))), keep=["_all"])
    return judged.filter("kept").select("_all.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs, shingle=SHINGLE, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    held = docs.withColumn("_all", F.struct(*map(quoted, docs.columns)))
    found = decontam.decontaminate(held, table(spark, sf_dir, "benchmark"), keep=["_all"])
    return found.filter("NOT contaminated").select("_all.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds."""
    return _counted(pii.redact(docs))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of each; those of which it takes none go."""
    taken = mixing.mix(docs)
    return taken.filter("taken > 0")


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
