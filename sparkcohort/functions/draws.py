"""A counter-based random generator in plain integer arithmetic.

The draw is a pure function of (seed, key, replicate): the same for every partitioning, repeatable after a lost task, and
written with operators every SQL engine has.  Rounds apply x -> x^5 modulo the prime 2^31 - 1, which is a permutation.
"""

from __future__ import annotations

import math

PRIME = 2_147_483_647
KEY_STEP = 48_271
REPLICATE_STEP = 69_621
HIGH_STEP = 39_373


def round_text(x: str) -> str:
    """One permutation round over a BIGINT expression below 2^31."""
    square = f"(({x}) * ({x}) % {PRIME})"
    return f"(({square} * {square} % {PRIME}) * ({x}) % {PRIME})"


def _reduced(x: str) -> str:
    """Remainder between 0 and the prime, for negative numbers too."""
    return f"((({x}) % {PRIME} + {PRIME}) % {PRIME})"


def key_input(key: str, seed: int) -> str:
    """Input of the first round, from the low part of a row key."""
    return f"({_reduced(key)} * {KEY_STEP} + {seed % PRIME}) % {PRIME}"


def key_second_input(first: str, key: str, divide: str = "DIV") -> str:
    """Input of the second round, which adds the high part; ``divide`` is the integer division operator of the engine."""
    return f"({first} + {_reduced(f'({key}) {divide} {PRIME}')} * {HIGH_STEP}) % {PRIME}"


def draw_input(key_hash: str, replicate: str) -> str:
    """Input of the last round: the hashed row key (two rounds, once per row) moved by the replicate."""
    return f"({key_hash} + ({replicate}) * {REPLICATE_STEP}) % {PRIME}"


def poisson_thresholds(last: int = 12) -> list[int]:
    """Draw bounds of a Poisson(1) weight: the weight is k when the draw lies below bound k and not below bound k-1."""
    out, total, term = [], 0.0, math.exp(-1.0)
    for k in range(last + 1):
        total += term
        out.append(math.ceil(total * PRIME))
        term /= k + 1
    return out


def poisson_weight(draw: str) -> str:
    cases = " ".join(f"WHEN {draw} < {bound} THEN {k}" for k, bound in enumerate(poisson_thresholds()))
    return f"CASE {cases} ELSE {len(poisson_thresholds())} END"
