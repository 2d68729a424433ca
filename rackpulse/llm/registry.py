"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from rackpulse.llm import (
    decontam,
    language,
    lexical,
    licenses,
    merkle,
    mixing,
    near,
    quality,
    suffixes,
    tokens,
    topk,
    toxicity,
    warc,
)

QUERIES = {
    "op1_token_counts": tokens.op1_token_counts,
    "op2_language": language.op2_language,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality": quality.op4_quality,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_topk_search": topk.op6_topk_search,
    "op7_mixing": mixing.op7_mixing,
    "op8_ngram_jaccard_join": near.op8_ngram_jaccard_join,
    "op9_warc": warc.op9_warc,
    "op10_decontamination": decontam.op10_decontamination,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_suffix_dedup": suffixes.op12_suffix_dedup,
    "op13_lexical_search": lexical.op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op3_license_scan": licenses.ORACLE_SQL,
    "op6_topk_search": topk.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_decontamination": decontam.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
}
