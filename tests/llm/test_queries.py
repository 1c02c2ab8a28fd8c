"""The queries over the smallest data: oracles, labels, and what must hold."""

from __future__ import annotations

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")

from loam.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(name, same_rows):
    same_rows(queries.Q[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.Q) - set(queries.SQL)))
def test_runs(name, spark):
    assert queries.Q[name](spark, DATA).count() > 0


def test_labels(spark):
    """Kinds against what authors wrote: no label of a list, table or junk is missed, no prose taken for one."""
    found = queries.p10_statistics(spark, DATA).join(spark.read.parquet(f"{DATA}/doc_labels.parquet"), "doc_id")
    wrong = found.where("kind <> body_kind and not (kind = 'empty' and body_kind = 'prose')").count()
    assert wrong <= 0.02 * found.count()


def test_packed_whole(spark):
    packed = queries.p8_containers(spark, DATA).groupBy("container").sum("n_tokens").collect()
    assert max(r[1] for r in packed) <= queries.CAPACITY
    assert sum(r[1] for r in packed) > 0.9 * queries.CAPACITY * len(packed)
