"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlode.llm import attention_lm, bpe, conversation, decontaminate, htmltree, merkle, piece, quality, sharding, simhash, substring, urlfilter, warc


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _over("documents", simhash.op1_simhash),
        "op2_substring": _over("documents", substring.op2_substring),
        "op3_quality": _over("documents", quality.op3_quality),
        "op4_lm": _over("documents", attention_lm.op4_lm),
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_bpe": _over("documents", bpe.op6_bpe),
        "op7_shards": _over("documents", sharding.op7_shards),
        "op8_urls": _over("pages", urlfilter.op8_urls),
        "op9_html": _over("pages", htmltree.op9_html),
        "op10_warc": _over("pages", warc.op10_warc),
        "op11_pieces": _over("documents", piece.op11_pieces),
        "op12_merkle": _over("documents", merkle.op12_merkle),
        "op13_conversations": _over("conversations", conversation.op13_conversations),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": quality.SQL,
        "op5_decontaminate": decontaminate.SQL,
        "op8_urls": urlfilter.SQL,
        "op12_merkle": merkle.SQL,
        "op13_conversations": conversation.SQL,
    }
