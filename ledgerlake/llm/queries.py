"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .media import op3_media_columns
from .near_dedup import OP8_SQL, op8_minhash_near_dedup
from .packing import op6_best_fit_packing
from .pii import op10_personal_data
from .secrets import op5_secret_scan, op5_sql
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .token_counts import op9_token_counts
from .token_files import op7_token_planes
from .toxicity import op4_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_media_columns": op3_media_columns,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_planes": op7_token_planes,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_personal_data": op10_personal_data,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op5_secret_scan": op5_sql(),
    "op8_minhash_near_dedup": OP8_SQL,
}
