"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from voxelloom.llm import bloomlm, digests, langid, mixing, multiindex, nearjoin, repeats, runs, sampling, substring, trie, unigram, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, query):
    return lambda spark, sf_dir: query(_table(spark, sf_dir, name))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_scoring": _over("documents", bloomlm.op1_lm_scoring),
    "op2_suffix_array_dedup": _over("documents", repeats.op2_suffix_array_dedup),
    "op3_mix_sources": _over("documents", mixing.op3_mix_sources),
    "op4_exact_dedup": _over("documents", digests.op4_exact_dedup),
    "op6_language_id": _over("documents", langid.op6_language_id),
    "op7_fingerprints": _over("documents", sampling.op7_fingerprints),
    "op8_sentencepiece": _over("documents", unigram.op8_sentencepiece),
    "op9_ngram_jaccard_join": _over("documents", nearjoin.op9_ngram_jaccard_join),
    "op10_html_extraction": _over("pages", wrappers.op10_html_extraction),
    "op5_substring_dedup": _over("documents", substring.op5_substring_dedup),
    "op11_nearest_vectors": _over("embeddings", multiindex.op11_nearest_vectors),
    "op12_conversation_trie": _over("conversations", trie.op12_conversation_trie),
    "op13_periodic_runs": _over("documents", runs.op13_periodic_runs),
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": repeats.OP2_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_exact_dedup": digests.OP4_SQL,
    "op5_substring_dedup": substring.OP5_SQL,
    "op9_ngram_jaccard_join": nearjoin.OP9_SQL,
    "op10_html_extraction": wrappers.OP10_SQL,
    "op12_conversation_trie": trie.OP12_SQL,
    "op13_periodic_runs": runs.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
