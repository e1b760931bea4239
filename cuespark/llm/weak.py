"""Expectation-maximisation over counted vote patterns, for the weak-supervision operators.

Votes are aggregated on the executors to one row per distinct pattern; their number is bounded by
the number of voters (three values each), not by the data, so estimation runs over that table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD, BAD, ABSTAIN = 1, 0, 2


@dataclass
class Reliability:
    """prior: share of the positive class; for[j], against[j]: chance that voter j, if it votes,
    votes positive on a positive and on a negative case."""
    prior: float
    on_positive: list[float]
    on_negative: list[float]

    def log_odds(self, votes) -> float:
        z = math.log(self.prior / (1 - self.prior))
        for v, p, q in zip(votes, self.on_positive, self.on_negative):
            if v == GOOD:
                z += math.log(p / q)
            elif v == BAD:
                z += math.log((1 - p) / (1 - q))
        return z

    def posterior(self, votes) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.log_odds(votes)))))


def estimate(patterns: list[tuple[tuple[int, ...], int]], voters: int, prior: float = 0.8, on_positive: float = 0.9,
             on_negative: float = 0.4, smoothing: float = 5.0, rounds: int = 50) -> Reliability:
    """Reliabilities of `voters` from (votes, count) rows. Starting values are also the smoothing's mean.

    Rates stay within 0.01 and 0.99, and a voter is never taken to vote positive more often on
    negatives than on positives.
    """
    start = (prior, on_positive, on_negative)
    r = Reliability(prior, [on_positive] * voters, [on_negative] * voters)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass = [[[0.0, 0.0] for _ in range(voters)] for _ in (0, 1)]
        positives = 0.0
        for votes, n in patterns:
            w = r.posterior(votes)
            positives += n * w
            for j, v in enumerate(votes):
                if v != ABSTAIN:
                    mass[1][j][v] += n * w
                    mass[0][j][v] += n * (1 - w)

        def rate(m, mean):
            return min(0.99, max(0.01, (m[GOOD] + smoothing * mean) / (m[GOOD] + m[BAD] + smoothing)))

        p = [rate(m, start[1]) for m in mass[1]]
        q = [min(rate(m, start[2]), a) for m, a in zip(mass[0], p)]
        new = Reliability(min(0.99, max(0.01, (positives + smoothing * prior) / (total + smoothing))), p, q)
        moved = max(abs(a - b) for a, b in zip([r.prior, *r.on_positive, *r.on_negative], [new.prior, *p, *q]))
        r = new
        if moved < 1e-6:
            break
    return r


def code(votes: list[Column]) -> Column:
    """One number for a pattern of votes (base 3)."""
    total = F.lit(0)
    for v in votes:
        total = total * 3 + v
    return total.cast("long")


def decode(value: int, voters: int) -> tuple[int, ...]:
    out = []
    for _ in range(voters):
        value, v = divmod(value, 3)
        out.append(v)
    return tuple(reversed(out))


def vote(good: Column, bad: Column) -> Column:
    """Bad outweighs good; neither (or null) abstains."""
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def posterior(votes: list[Column], r: Reliability) -> Column:
    z = F.lit(math.log(r.prior / (1 - r.prior)))
    for v, p, q in zip(votes, r.on_positive, r.on_negative):
        z = z + F.when(v == GOOD, math.log(p / q)).when(v == BAD, math.log((1 - p) / (1 - q))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def counted(df: DataFrame, votes: list[Column]) -> list[tuple[tuple[int, ...], int]]:
    rows = df.groupBy(code(votes).alias("code")).count().collect()      # at most 3 ^ voters rows
    return sorted((decode(r["code"], len(votes)), r["count"]) for r in rows)
