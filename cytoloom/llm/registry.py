"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .bpe import op4_byte_bpe
from .decontaminate import op7_decontaminate
from .hamming import OP9_SQL, op9_hamming_top_k
from .ngram_join import OP10_SQL, op10_ngram_jaccard_join
from .pii import op1_pii_sanitise
from .quality import op5_quality
from .secrets import op2_secret_scan
from .toxicity import op3_toxicity
from .warc import OP6_SQL, op6_warc
from .urls import OP8_SQL, op8_url_filters

QUERIES = {f.__name__: f for f in (op1_pii_sanitise, op2_secret_scan, op3_toxicity, op4_byte_bpe, op5_quality, op6_warc, op7_decontaminate, op8_url_filters, op9_hamming_top_k, op10_ngram_jaccard_join)}

ORACLE_SQL = {"op6_warc": OP6_SQL, "op8_url_filters": OP8_SQL, "op9_hamming_top_k": OP9_SQL, "op10_ngram_jaccard_join": OP10_SQL}
