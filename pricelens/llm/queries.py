"""Registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pricelens.llm import bitplane, fingerprints, html_text, language, merkle, mixing, packing, pii, quality, secret_scan, sharding, simhash, substring
from pricelens.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


@query("op4_quality_rules", quality.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return docs.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in cols])


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return d.select(
        F.col("row.doc_id").alias("doc_id"), sharding.text_size(F.col("row.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.scan(docs, pii.train(docs)).withColumnRenamed("id", "doc_id")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return secret_scan.scan(docs, secret_scan.train()).withColumnRenamed("id", "doc_id")


@query("op11_merkle_manifest", merkle.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents").select(*merkle.FIELDS)).withColumnRenamed("id", "doc_id")


@query("op12_centroid_clustering", bitplane.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitplane.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.assigned.withColumnRenamed("id", "vec_id")


@query("op13_language_id", language.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.Profiles.collect(language.train(docs.where(~language.held_out(F.col("doc_id")))))
    return language.identify(docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text"), profiles).drop("text")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
