"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .byte_bpe import op13_query
from .chat_format import OP8_SQL, op8_query
from .embedding_dedup import op4_query
from .html_extract import op3_query
from .lexical_search import OP11_SQL, op11_query
from .mixing import OP2_SQL, op2_query
from .pii import op5_query
from .quality_classifier import op6_query
from .quality_rules import op9_query
from .sentencepiece_codec import op7_query
from .simhash import op10_query
from .source_divergence import OP12_SQL, op12_query
from .substring_dedup import OP1_SQL, op1_query

QUERIES = {
    "op1_substring_dedup": op1_query,
    "op2_source_mixing": op2_query,
    "op3_html_extraction": op3_query,
    "op4_embedding_dedup": op4_query,
    "op5_pii_skip_chain": op5_query,
    "op6_quality_classifier": op6_query,
    "op7_sentencepiece": op7_query,
    "op8_chat_formatting": op8_query,
    "op9_compression_bands": op9_query,
    "op10_simhash_trie": op10_query,
    "op11_ranked_search": op11_query,
    "op12_source_divergence": op12_query,
    "op13_byte_bpe": op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_source_mixing": OP2_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
