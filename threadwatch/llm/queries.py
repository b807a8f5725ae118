"""Registered queries of the subpackage, one per operator, and their DuckDB oracles."""

from __future__ import annotations

from threadwatch.llm.op1_decontamination import op1_benchmark_decontamination
from threadwatch.llm.op2_substring import OP2_SQL, op2_substring_dedup
from threadwatch.llm.op3_quality import op3_quality_classifier
from threadwatch.llm.op4_licenses import op4_license_scan
from threadwatch.llm.op5_token_counts import op5_token_counts
from threadwatch.llm.op6_near_dup import OP6_SQL, op6_minhash_near_dedup
from threadwatch.llm.op7_main_text import op7_min_cut_main_text
from threadwatch.llm.op8_ann import op8_rotated_codes_ann
from threadwatch.llm.op9_packing import op9_best_fit_packing
from threadwatch.llm.op10_url_filters import OP10_SQL, op10_url_filters
from threadwatch.llm.op11_token_files import op11_direct_token_files
from threadwatch.llm.op12_alignment import op12_shared_cut_alignment
from threadwatch.llm.op13_hard_negatives import OP13_SQL, op13_strassen_hard_negatives

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_min_cut_main_text": op7_min_cut_main_text,
    "op8_rotated_codes_ann": op8_rotated_codes_ann,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_url_filters": op10_url_filters,
    "op11_direct_token_files": op11_direct_token_files,
    "op12_shared_cut_alignment": op12_shared_cut_alignment,
    "op13_strassen_hard_negatives": op13_strassen_hard_negatives,
}

ORACLES = {
    "op2_substring_dedup": OP2_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op10_url_filters": OP10_SQL,
    "op13_strassen_hard_negatives": OP13_SQL,
}
