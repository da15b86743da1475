"""Registered queries with an oracle match DuckDB at sf0.01.

By default a representative subset runs (one or two per operator family);
``PROCMON_FULL_ORACLE=1`` runs every registered oracle (as the driver does).
"""

import os

import pytest

from conftest import SF_CHECK
from oracle import compare, duck
from procmon.plans import registry

registry.load_all()

SUBSET = [
    "t10_standard_features", "t4_duration", "p7_drop_last_activity", "p12_rare_to_other", "p20_clean_log",
    "o1b_open_cases_ties", "o2b_open_cases_sequential_ties", "l6_build_targets", "l10_prefix_label_regr",
    "d1b_temporal_split_ties", "d5_prefix_log", "e10_encode_combined", "e5_encode_index", "e7_encode_previous",
    "o1_open_cases", "e10d_encode_combined_segmented", "b4_apply_fallback", "m13_mean_predictor", "f5_predict_flow", "f5b_predict_flow_prefix_buckets",
    "l4b_joint_counts", "d2_random_split", "d4b_stratified_kfold", "m6_single_class_fallback", "m7b_parameters_per_label_and_bucket",
    "v5_score_table", "v12_stability", "s1_read_log", "s5_read_formulas", "r1_score_running", "r2_stream_state",
]
KEYS = sorted(registry.ORACLE) if os.environ.get("PROCMON_FULL_ORACLE") else [k for k in SUBSET if k in registry.ORACLE]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    s = registry.QUERIES[key](spark, SF_CHECK).toArrow()
    d = duck(SF_CHECK, registry.ORACLE[key])
    res = compare(s, d)
    assert res["names"], res
    assert res["rows_spark"] == res["rows_oracle"], res
    assert res["close"], res


def test_every_query_key_names_a_survey_operator():
    import re

    for key in registry.QUERIES:
        assert re.match(r"^[a-z][0-9]+[a-z]?_", key), key
