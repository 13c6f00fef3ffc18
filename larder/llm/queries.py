"""The queries of the thirteen operators and their DuckDB SQL, where SQL can express one."""

from __future__ import annotations

from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .language_id import op5_language_id
from .license_scan import op3_license_scan
from .lm_scoring import op7_lm_scoring
from .near_dedup import op6_near_dedup
from .nearest import op10_nearest
from .packing import op8_packing
from .periodic_runs import op11_periodic_runs
from .quality_rules import op1_quality_rules
from .sharding import op12_sharding
from .source_mix import OP9_SQL, op9_source_mix
from .toxicity import op2_toxicity
from .url_filter import OP4_SQL, op4_url_filter

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_toxicity, op3_license_scan, op4_url_filter, op5_language_id, op6_near_dedup, op7_lm_scoring, op8_packing, op9_source_mix, op10_nearest, op11_periodic_runs, op12_sharding, op13_fill_in_middle)}
SQL = {"op4_url_filter": OP4_SQL, "op9_source_mix": OP9_SQL, "op13_fill_in_middle": OP13_SQL}
