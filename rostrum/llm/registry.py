"""Queries of this subpackage, by the name under which they are registered."""

from rostrum.llm import oracles
from rostrum.llm.decontaminate import op10_benchmark_decontamination
from rostrum.llm.html_wrappers import op7_main_text
from rostrum.llm.language_id import op9_language_id
from rostrum.llm.line_dedup import op6_line_dedup
from rostrum.llm.log_bilinear import op11_language_model
from rostrum.llm.mixing import op4_mix_to_weights
from rostrum.llm.near_dedup import op8_near_dedup
from rostrum.llm.periodic_runs import op13_periodic_runs
from rostrum.llm.pii import op5_personal_data
from rostrum.llm.quality_rules import op3_adaptive_quality
from rostrum.llm.ranked_search import op12_ranked_search
from rostrum.llm.sharding import op2_kd_shards
from rostrum.llm.substring_dedup import op1_substring_dedup

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_kd_shards, op3_adaptive_quality, op4_mix_to_weights, op5_personal_data, op6_line_dedup, op7_main_text, op8_near_dedup, op9_language_id, op10_benchmark_decontamination, op11_language_model, op12_ranked_search, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op3_adaptive_quality": oracles.QUALITY, "op6_line_dedup": oracles.LINE_DEDUP, "op8_near_dedup": oracles.NEAR_DEDUP, "op10_benchmark_decontamination": oracles.DECONTAMINATION, "op12_ranked_search": oracles.RANKED_SEARCH, "op13_periodic_runs": oracles.PERIODIC_RUNS}
