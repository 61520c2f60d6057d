"""The registered queries of this subpackage and their cross-check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrlens.llm import ball_tree, cube_mix, divergence, html_density, jaccard_join, periodic_runs, prefix_trie, repeats, secret_entropy, spm_scan, token_records, warc, zstd_quality
from hrlens.llm.common import table
from hrlens.llm.oracle import SQL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_density.extract(pages).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its ids, and whether they decode
    to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = spm_scan.encode_and_back(docs, PIECES, carry=["doc_id"])
    return out.select("doc_id", "_tokens.n_tokens", "_tokens.ids_crc32", "_tokens.round_trip")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ball_tree.top_k(vectors, F.col("vec_id") % 50 == 0)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = cube_mix.taken(docs, carry=["doc_id"])
    return out.select("doc_id", *[f"_mix.{x}" for x in ("size", "source_size", "target", "taken")])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = secret_entropy.scan(docs)
    base = F.filter("_spans", lambda x: x["place"] < len(secret_entropy.KINDS))

    def count(place: int):
        return F.size(F.filter("_spans", lambda x: x["place"] == place)).cast("long").alias(f"n_{secret_entropy.KINDS[place]}")

    counts = [count(i) for i in range(len(secret_entropy.KINDS))]
    digest = F.sha2(secret_entropy.listed(base), 256).alias("base_sha256")
    return d.select("doc_id", *counts, digest, secret_entropy.listed(F.col("_spans")).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return divergence.judge(docs, carry=["doc_id"]).select("doc_id", *[f"_quality.{x}" for x in names])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_records.write_and_index(docs, token_records.Tokens(BYTE_BPE))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = zstd_quality.train(docs, table(spark, sf_dir, "labels"))
    out = zstd_quality.score(docs, model).select("doc_id", zstd_quality.held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(turns)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.without(docs, carry=["doc_id"])
    removed = F.aggregate("_repeats.spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select(
        "doc_id",
        "_repeats.n_bytes",
        removed.alias("n_removed"),
        F.size("_repeats.spans").cast("long").alias("n_spans"),
        F.sha2("_repeats.kept", 256).alias("kept_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.with_runs(docs, carry=["doc_id"])
    runs, best = F.col("_runs.runs"), periodic_runs.strongest(F.col("_runs.runs"))
    lines = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("doc_id", "_runs", best.alias("_best"), F.concat_ws("", lines).alias("_lines"))
    return found.select(
        "doc_id",
        F.size("_runs.runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{x}").alias(x) for x in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"),
        F.sha2("_runs.collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    import corpus_pipeline

    ops = (
        op1_html_extraction,
        op2_sentencepiece,
        op3_top_k,
        op4_source_mix,
        op5_secret_scan,
        op6_quality_rules,
        op7_warc,
        op8_token_records,
        op9_jaccard_join,
        op10_quality_classifier,
        op11_prefix_trie,
        op12_suffix_dedup,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
