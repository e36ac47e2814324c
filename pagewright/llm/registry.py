"""Queries of this subpackage by name, and their DuckDB SQL."""

from __future__ import annotations

from pagewright.llm import op1_decontaminate, op2_minhash, op6_repeats, op9_mix
from pagewright.llm.op3_chat import op3_chat
from pagewright.llm.op4_quality import op4_quality
from pagewright.llm.op5_surrogates import op5_surrogates
from pagewright.llm.op7_html import op7_html
from pagewright.llm.op8_token_store import op8_token_store
from pagewright.llm.op10_flac import op10_flac

QUERIES = {
    "op1_decontaminate": op1_decontaminate.op1_decontaminate,
    "op2_minhash": op2_minhash.op2_minhash,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_surrogates": op5_surrogates,
    "op6_repeats": op6_repeats.op6_repeats,
    "op7_html": op7_html,
    "op8_token_store": op8_token_store,
    "op9_mix": op9_mix.op9_mix,
    "op10_flac": op10_flac,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": op1_decontaminate.ORACLE,
    "op2_minhash": op2_minhash.ORACLE,
    "op6_repeats": op6_repeats.ORACLE,
    "op9_mix": op9_mix.ORACLE,
}
