"""The registered queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .run_index import removed

    return removed(table(spark, sf_dir, "documents"))


def op4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features, stored_media

    return media_features(stored_media(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, spans

    return digest(spans(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_feast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_run_index": op3_run_index,
    "op4_forest": op4_forest,
    "op5_media": op5_media,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_feast": op11_feast,
    "op12_url_filter": op12_url_filter,
    "op13_divergence": op13_divergence,
}

ORACLE: dict[str, str] = {"op12_url_filter": url_filter.oracle(), "op13_divergence": divergence.oracle()}
