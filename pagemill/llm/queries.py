"""The registered queries of the ten operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .embeddings import OP1_SQL, op1_embedding_near_dups
from .fingerprints import op2_fingerprints
from .html_text import op8_html_text
from .langid import op6_language_id
from .lines import op9_line_dedup
from .mixing import op7_mix_sources
from .ngram_join import OP5_SQL, op5_ngram_join
from .pieces import op3_sentencepiece
from .substrings import OP10_SQL, op10_substring_dedup
from .toxicity import op4_toxicity

QUERIES = {
    "op1_embedding_near_dups": op1_embedding_near_dups,
    "op2_fingerprints": op2_fingerprints,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_language_id": op6_language_id,
    "op7_mix_sources": op7_mix_sources,
    "op8_html_text": op8_html_text,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES = {
    "op1_embedding_near_dups": OP1_SQL,
    "op5_ngram_join": OP5_SQL,
    "op10_substring_dedup": OP10_SQL,
}
