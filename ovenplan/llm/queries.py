"""Contract queries over the operators of this package: thin digests, no logic of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ovenplan.llm import (
    divergence,
    fim,
    line_dedup,
    line_quality,
    mixing,
    near_dups,
    neighbours,
    packing,
    pages,
    pieces,
    quality_rules,
    sharding,
    topk,
)
from ovenplan.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text of the ids, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_digests(docs, vocabulary("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then fences per language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents go from every document."""
    kept = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: five-word runs, edit similarity of 0.8 or more."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), similarity=0.8)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; four fifths of the labels may teach."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = line_quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return line_quality.score(docs, field, keep_text=False).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to bit-packed files in the order of ids, and back from the files."""
    manifest = packing.write_packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return packing.read_packed(manifest)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all sources; ``first_ppm`` is the first training position in millionths, null if the mix leaves the document out."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    first = F.floor(F.get("positions", F.lit(0)) * 1_000_000)
    digest = plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_ppm"))
    return mixing.range_sorted(digest, "first_ppm", "doc_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes, equal texts together where they fit."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of a language, and the terms that set a source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors found for every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts rearranged for infilling, and each text rebuilt, as digests."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, keep_index=False)
    back = fim.restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_page_text": op4_page_text,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dups": op6_near_dups,
    "op7_line_quality": op7_line_quality,
    "op8_packed_ids": op8_packed_ids,
    "op9_source_mix": op9_source_mix,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_neighbours": op12_neighbours,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op1_top_k": topk.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
