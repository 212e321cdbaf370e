"""Queries of this package and their SQL, for the entry module at the repository top."""

from __future__ import annotations

from sedimenta.llm.compression_quality import op7_quality_classifier
from sedimenta.llm.decontaminate import OP9_SQL, op9_decontamination
from sedimenta.llm.licenses import op10_license_scan
from sedimenta.llm.near_dedup import OP3_SQL, op3_near_dedup
from sedimenta.llm.packing import op8_packing
from sedimenta.llm.quality_rules import op4_quality_rules
from sedimenta.llm.ranked_search import OP11_SQL, op11_ranked_search
from sedimenta.llm.resampling import OP12_SQL, op12_importance_resampling
from sedimenta.llm.suffix_dedup import OP6_SQL, op6_suffix_dedup
from sedimenta.llm.token_counts import op5_token_counts
from sedimenta.llm.toxicity import op1_toxicity
from sedimenta.llm.url_filter import op2_url_filter
from sedimenta.llm.vector_dedup import OP13_SQL, op13_vector_dedup

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filter": op2_url_filter,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_dedup": op13_vector_dedup,
}

#: SQL of the queries that DuckDB can express; the others are tested against brute force, round trips or held-out rows.
SQL = {"op3_near_dedup": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op9_decontamination": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_vector_dedup": OP13_SQL}
