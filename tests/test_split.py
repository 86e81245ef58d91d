"""The clarification and assessment split keeps groups whole and refuses instead of leaving out."""

import pytest

from evidara.operators import evaluation
from evidara.operators.checks import ContractError


def test_split_takes_requested_groups_and_refuses(spark):
    members = spark.createDataFrame([(g, f"{g}-{i}") for g in range(10) for i in range(5)], "group_id long, response_id string")
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "group_id long")
    got = evaluation.split_selection(members, ask(7, 2)).collect()
    assert {(r.split, r.group_id) for r in got} == {("clarification" if g in (2, 7) else "assessment", g) for g in range(10)} and len(got) == 50
    for requested in (ask(1, 2, 3), ask(), ask(99), ask(1, 1)):  # 15 above 12, 50 above 48, unknown, doubled
        with pytest.raises(ContractError):
            evaluation.split_selection(members, requested)
    assert {(r.split, r.n_groups, r.n_responses, r.refused) for r in evaluation.split_report(members, ask(1, 2, 3)).collect()} == {("clarification", 3, 15, True), ("assessment", 7, 35, False)}
