"""Queries of this subpackage and their SQL; ``__spark_entry__`` adds them when it can import this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from triplewright.llm import additive_ann, alignment, bpe, centroids, ctph, feistel, hdlang, hilbert, ngram_join, packing, pii, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weak_pii": pii.op1_weak_pii,
    "op2_ctph": ctph.op2_ctph,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_feistel_order": feistel.op4_feistel_order,
    "op5_hilbert_shards": hilbert.op5_hilbert_shards,
    "op6_bpe_replay": bpe.op6_bpe_replay,
    "op7_power_of_two": packing.op7_power_of_two,
    "op8_simhash": simhash.op8_simhash,
    "op9_additive_ann": additive_ann.op9_additive_ann,
    "op10_hd_language": hdlang.op10_hd_language,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_centroids": centroids.op13_centroids,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op11_ngram_join": ngram_join.ORACLE, "op13_centroids": centroids.ORACLE}
