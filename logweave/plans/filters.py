"""Repair filters."""

from __future__ import annotations

from ..operators.integrity import DEFAULT, DISCARD_EXISTING, RegionView


def keep_recent(region_id: int, view: RegionView, queue: int, kind: str, first: int | None, last: int | None) -> int:
    """Where a run leaves a hole or goes below the first index, give up what was there and go on from the run."""
    if kind == "ENTRIES" and view.count and not view.first <= first <= view.first + view.count:
        return DISCARD_EXISTING
    return DEFAULT
