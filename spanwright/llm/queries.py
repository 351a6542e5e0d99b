"""The queries of this package and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, phrases
from .bin_slack import op11_minimum_bin_slack
from .chat import op6_perspective_rotation
from .codes import op12_vector_codes
from .decontaminate import op2_benchmark_decontamination
from .packing import op1_best_fit_packing
from .phrases import op13_phrase_collocations
from .quality import op9_quality_rules
from .secrets import op3_secret_scan
from .simhash import op5_simhash_near_dedup
from .substring import op4_substring_dedup
from .suffixes import op10_run_length_dedup
from .token_files import op8_token_id_files
from .toxicity import op7_counterfactual_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_run_length_dedup": op10_run_length_dedup,
    "op11_minimum_bin_slack": op11_minimum_bin_slack,
    "op12_vector_codes": op12_vector_codes,
    "op13_phrase_collocations": op13_phrase_collocations,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_perspective_rotation": op6_perspective_rotation,
    "op7_counterfactual_toxicity": op7_counterfactual_toxicity,
    "op8_token_id_files": op8_token_id_files,
    "op9_quality_rules": op9_quality_rules,
}

ORACLES: dict[str, str] = {
    "op12_vector_codes": codes.ORACLE_SQL,
    "op13_phrase_collocations": phrases.ORACLE_SQL,
    "op6_perspective_rotation": chat.ORACLE_SQL,
}
