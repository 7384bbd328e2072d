"""Registered queries of this package and the SQL of those that SQL expresses."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .collocations import OP11_SQL, op11_collocations
from .embedding_forest import op10_projection_forest
from .fingerprint import op9_weighted_sampling
from .html_blocks import op6_html_blocks
from .ngram_join import op1_count_vector_join
from .packing import op5_cost_packing
from .pii import op3_weak_pii
from .resharding import op13_flow_resharding
from .spelling import op12_spelling_variants
from .substring_dedup import op4_sentence_spans
from .toxicity import op7_mil_toxicity
from .warc import OP8_SQL, op8_warc_archive

QUERIES = {
    "op1_count_vector_join": op1_count_vector_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_weak_pii": op3_weak_pii,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_cost_packing": op5_cost_packing,
    "op6_html_blocks": op6_html_blocks,
    "op7_mil_toxicity": op7_mil_toxicity,
    "op8_warc_archive": op8_warc_archive,
    "op9_weighted_sampling": op9_weighted_sampling,
    "op10_projection_forest": op10_projection_forest,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_flow_resharding": op13_flow_resharding,
}

ORACLE: dict[str, str] = {
    "op8_warc_archive": OP8_SQL,
    "op11_collocations": OP11_SQL,
}
