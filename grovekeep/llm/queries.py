"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import kept as keep_table
from . import (
    decontaminate, edit_fingerprints, html_text, merkle, mixing, near_dups, prefix_trie, quality, repeats, reshard, simhash, token_counts,
    toxicity,
)
from .common import read

VOCABULARY = "piece_bpe_32k.model"
SHARDS = 16
OLD_SHARDS = 12


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = labels.where(fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score_toxicity(toxicity.fit_lexicon(docs, known), docs)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = labels.where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(quality.fit_quality(docs, known), docs)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op5_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search: documents whose fingerprints are alike, each pair of documents in both directions."""
    prints = keep_table(edit_fingerprints.fingerprint_rows(read(spark, sf_dir, "documents")), "prints")
    # All against all: ten digits leave few chance meetings, and at 0.8 one octave alone finds 97 in 100.
    return edit_fingerprints.near_matches(prints, prints, digits=10)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "total", "coverage")


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    placed = reshard.reshard_files(docs, old_shard(), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def old_shard() -> Column:
    """Where the documents lie before: twelve shards by a hash of the text."""
    return F.pmod(reshard.text_crc32(), F.lit(OLD_SHARDS)).cast("int")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dups.near_groups(read(spark, sf_dir, "documents"), shingle=4)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return groups.select("doc_id", "n_shingles", "component_id", kept)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.vocabulary(VOCABULARY))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"), shingle=3)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every third document, by its id's checksum, the text has been tampered with: its A-Z are in lower case."""
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(fold(3) == 0, merkle.ascii_lower(F.col("text")))
    found = merkle.manifest(docs, tampered=tampered)
    folded = found.withColumns({"proof_sha256": merkle.proof_digest(F.col("path")), "folded_root": merkle.folded(F.col("changed"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text, op2_mix_sources, op3_toxicity, op4_quality, op5_edit_fingerprints, op5_near_matches, op6_decontaminate, op7_reshard,
        op8_repeats, op9_near_dups, op10_token_counts, op11_simhash, op12_merkle_manifest, op13_prefix_trie,
    )
}
