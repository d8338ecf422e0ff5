"""Registered queries of this subpackage with their SQL."""

from __future__ import annotations

from starfold.llm.embedding_dedup import op1_embedding_dedup
from starfold.llm.language_id import op13_language_id
from starfold.llm.mixing import OP2_SQL, op2_mixing
from starfold.llm.packing import op9_packing
from starfold.llm.pii import op5_pii
from starfold.llm.prefix_trie import OP12_SQL, op12_conversation_prefix_trie
from starfold.llm.quality_classifier import op10_quality_classifier
from starfold.llm.quality_rules import OP4_SQL, op4_quality_rules
from starfold.llm.sharding import op8_sharding
from starfold.llm.simhash_dedup import op3_simhash_dedup
from starfold.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from starfold.llm.substring_dedup import op7_substring_dedup
from starfold.llm.url_filter import OP6_SQL, op6_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup,
        op2_mixing,
        op3_simhash_dedup,
        op4_quality_rules,
        op5_pii,
        op6_url_filter,
        op7_substring_dedup,
        op8_sharding,
        op9_packing,
        op10_quality_classifier,
        op11_spelling_variants,
        op12_conversation_prefix_trie,
        op13_language_id,
    )
}
SQL = {"op2_mixing": OP2_SQL, "op4_quality_rules": OP4_SQL, "op6_url_filter": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op12_conversation_prefix_trie": OP12_SQL}
