"""The queries of this subpackage and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from .bpe import op6_byte_bpe
from .langid import op10_language_id
from .licenses import op3_license_scan
from .mixing import op9_mixing
from .ngram_join import op7_ngram_join
from .secrets import op4_secret_scan
from .token_counts import op2_token_counts
from .topk import OP5_SQL, op5_exact_topk
from .toxicity import op1_toxicity
from .vector_dedup import OP8_SQL, op8_vector_dedup

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_exact_topk": op5_exact_topk,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": OP5_SQL,
    "op8_vector_dedup": OP8_SQL,
}
