"""Every core query with an oracle gives the same rows in DuckDB; the others run."""

from __future__ import annotations

import pytest

from conftest import DATA
from loam.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()
SLOW = {"pu_train_score", "baseline_ladder", "permutation_importance", "ablation_grid", "shap_strata"}


@pytest.mark.skipif(not __import__("pathlib").Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.skipif(not __import__("pathlib").Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(name, spark):
    assert QUERIES[name](spark, DATA).count() > 0


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
