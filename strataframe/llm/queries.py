"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm import ann, chat, jaccard, langid, packing, pieces, quality, rules, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality": quality.op2_quality,
        "op3_nearest": ann.op3_nearest,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_sampled_pieces": pieces.op5_sampled_pieces,
        "op6_language_id": langid.op6_language_id,
        "op7_quotation_links": chat.op7_quotation_links,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_url_filter": urls.op9_url_filter,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": urls.sql(), "op10_warc": warc.SQL}
