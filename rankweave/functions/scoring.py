"""Pluggable scorers: user functions adapted to `scores(user, shown items)`, checked and batched."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from numbers import Real


def checked(scores: Sequence, n: int) -> list[float]:
    out = list(scores)
    if len(out) != n:
        raise ValueError(f"{n} candidates, {len(out)} scores")
    if any(isinstance(s, bool) or not isinstance(s, Real) or not math.isfinite(s) for s in out):
        raise ValueError("scores are finite numbers")
    return [float(s) for s in out]


def from_scores(f: Callable[[str, Sequence[str]], Sequence[float]], higher_is_better: bool = True) -> Callable[[str, Sequence[str]], list[float]]:
    sign = 1.0 if higher_is_better else -1.0
    return lambda user, shown: [sign * s for s in checked(f(user, shown), len(shown))]


def from_order(f: Callable[[str, Sequence[str]], Sequence[str]]) -> Callable[[str, Sequence[str]], list[float]]:
    """An order callback names every shown item once; rank r of n scores n - r."""

    def scores(user: str, shown: Sequence[str]) -> list[float]:
        order = list(f(user, shown))
        if len(set(order)) != len(order):
            raise ValueError("an item is named twice")
        if set(order) != set(shown):
            raise ValueError("the order names other items than are shown")
        rank = {x: i for i, x in enumerate(order)}
        return [float(len(shown) - rank[x]) for x in shown]

    return scores


def from_orders(f: Callable[[Sequence[tuple[str, Sequence[str]]]], Sequence[Sequence[str]]]) -> Callable[[Sequence[tuple[str, Sequence[str]]]], list[list[float]]]:
    """A batch scorer of a callback that orders several lists at once; each order names every item shown once."""

    def scores(lists: Sequence[tuple[str, Sequence[str]]]) -> list[list[float]]:
        orders = list(f(lists))
        if len(orders) != len(lists):
            raise ValueError(f"{len(lists)} lists, {len(orders)} orders")
        return [from_order(lambda _, __, o=order: o)(user, shown) for (user, shown), order in zip(lists, orders, strict=True)]

    return scores


def digest_scores(lists: Sequence[tuple[str, Sequence[str]]]) -> list[list[float]]:
    """A batch scorer that needs no model: an item's score is a digest of user and item, wherever it is shown. For trials and tests."""
    return [[int(hashlib.md5(f"{user}#{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in shown] for user, shown in lists]


#: Architecture presets (mask, position ids, interaction) and our names for them.
ARCHITECTURES = {("causal", "standard", "none"): "causal", ("block", "shared", "none"): "block", ("block", "shared", "relational"): "block_setwise"}


def architecture_of(mask: str, positions: str, interaction: str = "none") -> str:
    try:
        return ARCHITECTURES[mask, positions, interaction]
    except KeyError:
        raise ValueError(f"no architecture has mask {mask}, positions {positions} and interaction {interaction}") from None
