"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from rankloom.llm.html import op6_main_text
from rankloom.llm.language import op9_language
from rankloom.llm.lines import op7_lines
from rankloom.llm.mixing import OP2_SQL, op2_mixing
from rankloom.llm.packing import op5_best_fit_packing
from rankloom.llm.quality import OP10_SQL, op10_quality_rules
from rankloom.llm.simhash import op8_simhash
from rankloom.llm.spotsigs import op1_spotsigs
from rankloom.llm.substrings import op3_substrings
from rankloom.llm.tokens import op4_token_files


def queries() -> dict:
    return {f.__name__: f for f in (op1_spotsigs, op2_mixing, op3_substrings, op4_token_files, op5_best_fit_packing, op6_main_text, op7_lines, op8_simhash, op9_language, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2_SQL, "op10_quality_rules": OP10_SQL}
