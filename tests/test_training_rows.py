"""The training set's scans carry and shuffle only what its readers name."""

import re

from conftest import SF

from peerscope.plans import chance
from peerscope.plans.learned import FEATURES
from peerscope.plans.star import Star


def test_only_named_inputs_are_counted(spark):
    t = chance.training_set(Star(spark, SF), FEATURES)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "kills_lost_100" in plan and "heralds_100" not in plan and "plates_lost_100" not in plan and "held_100" not in plan
    assert t.columns == ["match_id", "t", "side", *FEATURES, "won"]


def test_stacked_rows_are_not_shuffled(spark):
    plan = chance.training_set(Star(spark, SF), FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange [^\n]*\n[\s:+|*()\d-]*Union", plan)
