"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at what the level before left undecided:

1. texts are grouped by the length of the normalised text; a length that occurs once is decided;
2. the rest is grouped by (length, hash of the first ``prefix`` characters);
3. only groups that survive get their full content hashed (SHA-256) and compared.

All levels move narrow rows (ids, lengths, hashes): the text is never shuffled. Groups are
formed by aggregation with map-side combining, written, and joined back on the keys, so a group
that holds a third of all rows costs one row per task and Spark can split it where it is joined.

Defined cases: a null text counts as empty; empty texts equal each other; a null doc_id never
is ``keep_id`` unless all ids of its group are null (then ``keep_id`` is null and ``kept`` false
for none: such rows are all kept, as nothing tells them apart); rows repeated with the same
doc_id and text share one outcome; very long texts are compared whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, materialize


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, level, text_sha256.

    ``level`` is the refinement at which the row was decided (1 length, 2 prefix, 3 full hash).
    With ``digest_all`` every row needs its digest anyway, so one scan takes lengths, prefix
    hashes and digests together; without it a second scan hashes only the texts that survive
    the first two levels, and ``text_sha256`` is null for the others.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.octet_length(norm).cast("long").alias("len"), F.xxhash64(F.substring(norm, 1, prefix)).alias("head"), F.col(id_col).alias("doc_id"), norm.alias("norm"))
    full = F.sha2(F.col("norm").cast("binary"), 256).alias("full")
    narrow = materialize(texts.select("doc_id", "len", "head", *([full] if digest_all else [])), "exact-dedup")
    count = F.count(F.lit(1)).alias("n")
    lengths = materialize(narrow.groupBy("len").agg(count).where("n > 1").select("len", F.lit(2).alias("by_len")), "exact-dedup-lengths")
    heads = narrow.join(lengths, "len", "left_semi").groupBy("len", "head").agg(count).where("n > 1").select("len", "head", F.lit(True).alias("by_head"))
    heads = materialize(heads, "exact-dedup-heads")
    key = ["len", "head"]
    if digest_all:
        survive = narrow.join(heads, key, "left_semi")
    else:
        # A filter keeps decided texts back; the others are hashed where they lie, so no text is shuffled.
        near, _ = bloom.split(texts, bloom.of_docs(heads.select(F.col("len").alias("doc"), F.col("head").alias("tkey"))))
        survive = materialize(near.select("doc_id", *key, full).join(heads, key, "left_semi"), "exact-dedup-survivors")
    groups = survive.groupBy(*key, "full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "exact-dedup-groups")
    if digest_all:
        decided = narrow.join(lengths, "len", "left").join(heads, key, "left")
    else:
        early = narrow.join(heads, key, "left_anti").join(lengths, "len", "left").withColumns({"by_head": F.lit(None).cast("boolean"), "full": F.lit(None).cast("string")})
        decided = early.unionByName(survive.withColumns({"by_len": F.lit(2), "by_head": F.lit(True)}))
    found = decided.join(groups, [*key, "full"], "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.when(F.col("by_head"), 3).otherwise(F.coalesce("by_len", F.lit(1))).alias("level"),
        F.col("full").alias("text_sha256"),
    )
