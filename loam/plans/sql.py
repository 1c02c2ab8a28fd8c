"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

_A = 6378137.0


def laea_sql(lon: str, lat: str) -> str:
    """The published closed form in SQL (Snyder 1987)."""
    e2 = "0.0066943800229007869"
    e = f"sqrt({e2})"

    def q(s: str) -> str:
        return f"((1 - {e2}) * (({s}) / (1 - {e2} * ({s}) * ({s})) - ln((1 - {e} * ({s})) / (1 + {e} * ({s}))) / (2 * {e})))"

    s0 = "sin(radians(52.0))"
    return f"""select *, asin({q('sin(radians(' + lat + '))')} / qp) beta, radians({lon}) - radians(10.0) dl, {_A} * sqrt(qp / 2) rq, asin({q(s0)} / qp) b0, {_A} * cos(radians(52.0)) / sqrt(1 - {e2} * {s0} * {s0}) m1
from (select *, {q('1.0')} qp from {{0}})"""
