"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tillwork.llm.ann import op4_nearest
from tillwork.llm.byte_bpe import op7_byte_bpe
from tillwork.llm.chat import OP9_SQL, op9_chat_formatting
from tillwork.llm.chat_repair import OP11_SQL, op11_chat_repair
from tillwork.llm.exact_dedup import OP12_SQL, op12_exact_dedup
from tillwork.llm.fertility import op2_quality_rules
from tillwork.llm.lm import op10_lm_scoring
from tillwork.llm.packing import op3_packing
from tillwork.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from tillwork.llm.secret_scan import op8_secret_scans
from tillwork.llm.simhash import op6_simhash
from tillwork.llm.suffix_dedup import op5_suffix_dedup
from tillwork.llm.token_counts import OP1_SQL, op1_token_counts


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_packing": op3_packing,
        "op4_nearest": op4_nearest,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_simhash": op6_simhash,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_secret_scans": op8_secret_scans,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_chat_repair": op11_chat_repair,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_token_counts": OP1_SQL, "op9_chat_formatting": OP9_SQL, "op11_chat_repair": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
