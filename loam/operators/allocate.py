"""Sharing a fixed number of places among groups."""

from __future__ import annotations


def allocate_capped(weights: dict[object, float], total: int, least: int = 1, most: int = 12) -> dict[object, int]:
    """Whole places in proportion to weights, each group between ``least`` and ``most`` and ``total`` in all if the bounds allow it.

    Groups start at ``least``; each further place goes to the group below ``most`` whose share is furthest behind, ties to the smaller
    name. Without weights (all 0) shares are even. More groups than places: every group keeps ``least``.
    """
    names = sorted(weights, key=str)
    whole = sum(max(0.0, weights[k]) for k in names)
    want = {k: total * (max(0.0, weights[k]) / whole if whole else 1 / len(names)) for k in names}
    got = dict.fromkeys(names, least)
    for _ in range(max(0, total - least * len(names))):
        room = [k for k in names if got[k] < most]
        if not room:
            break
        k = max(room, key=lambda n: (want[n] - got[n], -names.index(n)))
        got[k] += 1
    return got
