"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import align, bpe, chat, decontaminate, extract, fingerprint, jaccard, langid, lm, quality, search, secrets, suffixes


def queries():
    return {f.__name__: f for f in (suffixes.op1_suffix_dedup, chat.op2_chat, jaccard.op3_jaccard, fingerprint.op4_fingerprint, decontaminate.op5_decontaminate, langid.op6_langid, secrets.op7_secrets, lm.op8_lm, quality.op9_quality, bpe.op10_bpe, align.op11_align, search.op12_search, extract.op13_extract)}


def oracle_sql() -> dict[str, str]:
    return {"op12_search": search.SQL}
