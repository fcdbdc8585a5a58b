"""A corpus pipeline from the corpus operators.

Toxic documents go, duplicate lines go, one document of each near-duplicate group stays, the
sources are interleaved at target weights, and the texts are encoded. Every stage takes the
documents its predecessor kept and, but for the last, returns the columns of documents.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as
the operators' docstrings say; extra columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.llm.bpe import bpe
from slopeline.llm.common import materialize, read_table
from slopeline.llm.line_dedup import line_dedup
from slopeline.llm.mixing import in_mix_order, mix_sources
from slopeline.llm.simhash import keep_one
from slopeline.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the model learns from the labels of documents at hand."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), read_table(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*rest).alias("rest")) if rest else docs
    kept = score(packed, model).where("tox_flag = 0")
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with lines cut that are nearly the same as an earlier one."""
    return line_dedup(docs, min_chars=1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    Fingerprints at most 9 bits apart over five segments are candidates; their texts are compared.
    """
    return keep_one(docs, shingle=5, similarity=0.8, distance=9, segments=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a mix that draws sources by the root of their sizes."""
    packed = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    return in_mix_order(mix_sources(packed)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of ids and of the text decoded from them."""
    import public_tokenizers

    return bpe(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, with_digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: No SQL can express the toxicity model; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
