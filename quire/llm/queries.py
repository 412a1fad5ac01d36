"""The registered queries of this subpackage: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, html_main, importance, language_id, line_dedup, maxent, quality_rules, simhash, toxicity, warc, weak_labels, whitening
from quire.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the public vocabulary; a parameter of the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer()
    out = bpe.encode(read(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.records_of_pages(read(spark, sf_dir, "pages")))
    return warc.digest(out)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.classify(read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("item_ids")


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(read(spark, sf_dir, "pages"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(read(spark, sf_dir, "embeddings")))


def op13_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_model(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc_revisit": op4_warc_revisit,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_main": op10_html_main,
    "op11_importance": op11_importance,
    "op12_whitening": op12_whitening,
    "op13_maxent": op13_maxent,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_warc_revisit": warc.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_importance": importance.ORACLE,
}
