"""Rule classifiers and gates as column expressions. ``v`` are features, ``q`` their fixed-point forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .features import f32

# Thresholds of the rules.
HEURISTIC_RATIO = 0.0695191446


def heuristic_votes(v: Sequence[Column]) -> Column:
    return F.when(v[2] >= f32(HEURISTIC_RATIO), 5).otherwise(0)


def fast_path_score(v: Sequence[Column]) -> Column:
    terms = [f32(5.0) * v[2], f32(5.0) * v[7], f32(2.0) * v[8], v[9], v[11], v[12], v[0]]
    return reduce(lambda a, b: a + b, terms)


def fast_path_votes(v: Sequence[Column]) -> Column:
    """0 or 5 where a chain of thresholds decides, else -1. The first that applies wins."""
    s = fast_path_score(v)
    chain = [  # fixed values
        (s < f32(1.95), 0),
        (s > f32(11.1), 5),
        (v[0] <= f32(0.0387315), 0),
        (v[3] <= f32(0.23913044), 5),
        (v[5] > f32(0.08368056), 0),
        (v[0] > f32(0.322186), 5),
        (v[1] <= f32(0.20833334), 0),
        (v[1] > f32(0.625), 5),
        (v[7] <= f32(0.02350026), 0),
        (v[8] <= f32(0.175), 0),
        (v[8] > f32(0.575), 5),
    ]
    out = F.when(*_pair(chain[0]))
    for c in chain[1:]:
        out = out.when(*_pair(c))
    return out.otherwise(-1)


def _pair(c: tuple[Column, int]) -> tuple[Column, Column]:
    return c[0], F.lit(c[1])


def ambiguous(votes: Column) -> Column:
    return votes.between(1, 4)


def low_margin(votes: Column) -> Column:
    """No sixth neighbour is kept, so there is no margin to be low."""
    return F.lit(False)


def low_risk_denial(votes: Column, q: Sequence[Column]) -> Column:
    """Denials that look like low risk."""
    small = (q[0] <= 600) & (q[2] <= 2000) & (q[7] <= 2000) & (q[8] <= 2500) & (q[10] >= 10000) & (q[12] <= 2000)
    offline = (q[0] <= 3500) & (q[7] <= 1200) & (q[9] == 0) & (q[10] >= 10000) & (q[12] <= 2000)
    narrow = q[0].between(2800, 3200) & (q[2] >= 5500) & (q[7] <= 600) & (q[8] <= 3200) & (q[11] >= 10000) & (q[12] >= 4500) & (q[13] <= 150)
    cheap = (q[0] <= 2700) & (q[1] <= 5000) & (q[13] <= 300)
    return ((votes == 4) & small) | ((votes == 5) & (small | offline | narrow | cheap))


def high_risk_approval(votes: Column, q: Sequence[Column]) -> Column:
    """Approvals that look like high risk."""
    far = (q[10] >= 10000) & (q[2] >= 4500) & (q[7] >= 3000) & (q[8] >= 3000) & (q[12] <= 2000)
    risky = (q[10] >= 10000) & (q[2] >= 2000) & (q[8] >= 1500) & (q[12] >= 4000)
    small_shop = (q[13] <= 250) & q[7].between(1000, 1800) & q[8].between(1800, 2600) & (q[2] >= 2500)
    first = (q[5] < 0) & (q[6] < 0) & (q[0] <= 1200) & (q[2] >= 3000) & (q[7] <= 1300) & (q[8] <= 2500) & q[12].between(2500, 3500)
    busy = (q[0] <= 1200) & (q[8] >= 3500) & (q[12] >= 2500)
    return (votes <= 1) & (far | risky | small_shop | first | busy)


def gate(votes: Column, q: Sequence[Column]) -> Column:
    """Whether a first answer is searched again. The rules it joins have fixed values."""
    return ambiguous(votes) | low_margin(votes) | low_risk_denial(votes, q) | high_risk_approval(votes, q)


def approved(votes: Column) -> Column:
    return votes < 3


def fraud_score(votes: Column) -> Column:
    return votes.cast("float") / F.lit(5.0)


def response_json(votes: Column) -> Column:
    """The answer's body; malformed requests count as no votes."""
    n = F.coalesce(votes, F.lit(0))
    return F.concat(F.lit('{"approved":'), F.when(n < 3, "true").otherwise("false"), F.lit(',"fraud_score":'), F.element_at(F.array(*[F.lit(f"{k / 5:.1f}") for k in range(6)]), n.cast("int") + 1), F.lit("}"))
