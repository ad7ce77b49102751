"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from lectern.llm.alignment import op11_alignment
from lectern.llm.decontaminate import OP4_SQL, op4_decontaminate
from lectern.llm.html_text import op3_html_text
from lectern.llm.lm_score import op10_lm_score
from lectern.llm.near_dedup import op9_bag_minhash
from lectern.llm.pieces import op1_pieces
from lectern.llm.quality import op2_quality
from lectern.llm.simhash_trie import op12_simhash
from lectern.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from lectern.llm.suffix_dedup import op5_suffix_dedup
from lectern.llm.token_counts import op8_token_counts
from lectern.llm.toxicity import op6_toxicity
from lectern.llm.variants import op13_variants

QUERIES = {
    f.__name__: f
    for f in (op1_pieces, op2_quality, op3_html_text, op4_decontaminate, op5_suffix_dedup, op6_toxicity, op7_substring_dedup, op8_token_counts, op9_bag_minhash, op10_lm_score, op11_alignment, op12_simhash, op13_variants)
}

ORACLE_SQL = {"op4_decontaminate": OP4_SQL, "op7_substring_dedup": OP7_SQL}
