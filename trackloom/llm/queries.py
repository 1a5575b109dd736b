"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from .bpe_automaton import op4_bpe_automaton
from .centroids import OP12_SQL, op12_centroids
from .decontaminate import OP1_SQL, op1_decontaminate
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .licenses import op9_licenses
from .lm_score import op7_lm_score
from .near_dedup import op8_near_dedup
from .sharding import OP3_SQL, op3_interleaved_shards
from .token_counts import op10_token_counts
from .toxicity import op2_toxicity
from .url_filter import OP13_SQL, op13_url_filter
from .vector_codes import OP11_SQL, op11_vector_codes
from .warc_fixity import OP5_SQL, op5_warc_fixity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_interleaved_shards": op3_interleaved_shards,
    "op4_bpe_automaton": op4_bpe_automaton,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_lm_score": op7_lm_score,
    "op8_near_dedup": op8_near_dedup,
    "op9_licenses": op9_licenses,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_centroids": op12_centroids,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op3_interleaved_shards": OP3_SQL,
    "op5_warc_fixity": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_centroids": OP12_SQL,
    "op13_url_filter": OP13_SQL,
}
