"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op6_nearest
from .bpe import op3_bpe
from .embedding_dedup import op10_embedding_dedup
from .lm_score import op1_lm_score
from .ngram_join import op4_ngram_jaccard
from .packing import op9_packing
from .secrets import op7_secrets
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op8_toxicity
from .url_filter import ORACLE_SQL as URL_SQL
from .url_filter import op2_url_filters

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_url_filters, op3_bpe, op4_ngram_jaccard, op5_suffix_dedup, op6_nearest, op7_secrets, op8_toxicity, op9_packing, op10_embedding_dedup)}
ORACLE_SQL = {"op2_url_filters": URL_SQL}
