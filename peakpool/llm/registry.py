"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from peakpool.llm import bpe, decontaminate, htmltext, langid, lm, quality, simhash, substrings, tokencount, urlfilter


def queries() -> dict:
    return {"op1_bpe": bpe.op1_bpe, "op2_lm": lm.op2_lm, "op3_langid": langid.op3_langid, "op4_urlfilter": urlfilter.op4_urlfilter, "op5_simhash": simhash.op5_simhash, "op6_quality": quality.op6_quality, "op7_decontaminate": decontaminate.op7_decontaminate, "op8_htmltext": htmltext.op8_htmltext, "op9_substrings": substrings.op9_substrings, "op10_tokencount": tokencount.op10_tokencount}


def oracle_sql() -> dict[str, str]:
    return {"op4_urlfilter": urlfilter.sql()}
