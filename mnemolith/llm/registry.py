"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, exact_dedup, langid, license_scan, mixing, ngram_join, packing, substring_dedup, toxicity, warc, whitening, yinyang

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_warc": warc.op2_warc,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_langid": langid.op5_langid,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_packing": packing.op9_packing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_yinyang": yinyang.op12_yinyang,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op2_warc": warc.SQL,
    "op3_mixing": mixing.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_license_scan": license_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_yinyang": yinyang.SQL,
}
