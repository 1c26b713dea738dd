"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from colframe.llm import bpe, imatch, licences, lines, mixing, pii, quality, records, simhash, suffixes

QUERIES = {
    "op1_imatch": imatch.op1_imatch,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_lines": lines.op4_lines,
    "op5_quality": quality.op5_quality,
    "op6_pii": pii.op6_pii,
    "op7_records": records.op7_records,
    "op8_licences": licences.op8_licences,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {
    "op4_lines": lines.ORACLE,
    "op5_quality": quality.ORACLE,
    "op9_suffixes": suffixes.ORACLE,
    "op8_licences": licences.ORACLE,
}
