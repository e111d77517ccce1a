"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, decontam, katz, langid, licenses, media, quotes, simhash, toxicity, wrappers

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_quotes": quotes.op2_quotes,
    "op3_simhash": simhash.op3_simhash,
    "op4_wrappers": wrappers.op4_wrappers,
    "op5_licenses": licenses.op5_licenses,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_katz": katz.op7_katz,
    "op8_bpe": bpe.op8_bpe,
    "op9_media": media.op9_media,
    "op10_decontamination": decontam.op10_decontamination,
    "benchmark_proximity": decontam.benchmark_proximity,
    "license_base": licenses.license_base,
    "quoted_conversations": quotes.quoted_conversations,
    "katz_base": katz.katz_base,
}

ORACLE_SQL: dict[str, str] = {
    "op10_decontamination": decontam.ORACLE_SQL,
    "benchmark_proximity": decontam.PROXIMITY_SQL,
    "license_base": licenses.BASE_SQL,
    "quoted_conversations": quotes.QUOTED_SQL,
    "katz_base": katz.BASE_SQL,
}
