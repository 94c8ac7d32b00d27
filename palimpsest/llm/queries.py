"""Queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from palimpsest.llm import decontaminate, minhash
from palimpsest.llm.decontaminate import op10_decontaminate
from palimpsest.llm.lattice_lm import op6_lattice_lm
from palimpsest.llm.line_dedup import op1_line_dedup
from palimpsest.llm.minhash import op8_minhash
from palimpsest.llm.packing import op2_packing
from palimpsest.llm.pii import op5_pii
from palimpsest.llm.quality_rules import op3_quality_rules
from palimpsest.llm.token_files import op4_token_files
from palimpsest.llm.toxicity import op9_toxicity
from palimpsest.llm.url_filter import op7_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_pii": op5_pii,
    "op6_lattice_lm": op6_lattice_lm,
    "op7_url_filter": op7_url_filter,
    "op8_minhash": op8_minhash,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE: dict[str, str] = {
    "op8_minhash": minhash.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
