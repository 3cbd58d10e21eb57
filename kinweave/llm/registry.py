"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .fingerprints import op1_fingerprints
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm import op7_lm_scoring
from .mixing import OP6_SQL, op6_mixing
from .ngram_join import op2_ngram_join
from .quality import op4_quality
from .sentencepieces import op9_sentencepiece
from .token_files import op3_token_files
from .toxicity import op8_toxicity
from .warc import op5_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_files": op3_token_files,
    "op4_quality": op4_quality,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
}
ORACLES = {"op6_mixing": OP6_SQL, "op10_line_dedup": OP10_SQL}
