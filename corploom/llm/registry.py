"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, embeddings, mixing, phrases, quality, resampling, sharding, simhash, substring, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_simhash": simhash.op3_simhash,
    "op4_urlfilter": urlfilter.op4_urlfilter,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_quality": quality.op6_quality,
    "op7_sharding": sharding.op7_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_bpe": bpe.op9_bpe,
    "op10_substring": substring.op10_substring,
    "op11_resampling": resampling.op11_resampling,
    "op12_mixing": mixing.op12_mixing,
    "op13_phrases": phrases.op13_phrases,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.OP2_SQL,
    "op4_urlfilter": urlfilter.OP4_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op12_mixing": mixing.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
