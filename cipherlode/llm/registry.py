"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cipherlode.llm import bpe, chat, decontam, embed, jaccard, langid, lm, spelling, suffix, toxic, trie, urls, warc
from cipherlode.llm.text import lean_workers


def _lean(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_jaccard_join": jaccard.op1_jaccard_join,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_url_filters": urls.op4_url_filters,
        "op5_embedding_dedup": embed.op5_embedding_dedup,
        "op6_language_id": langid.op6_language_id,
        "op7_toxicity": toxic.op7_toxicity,
        "op8_warc_fixity": warc.op8_warc_fixity,
        "op9_decontamination": decontam.op9_decontamination,
        "op10_lm_scoring": lm.op10_lm_scoring,
        "op11_chat_format": chat.op11_chat_format,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }
    return {name: _lean(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": urls.oracle(), "op8_warc_fixity": warc.ORACLE, "op11_chat_format": chat.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_spelling_variants": spelling.ORACLE}
