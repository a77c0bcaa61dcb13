"""Invented prose for the corpus tests."""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi tu re san bel dor fi ges hul vek".split()


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    own = words(n, seed)
    return "\n".join(" ".join(own[i : i + 12]) + "." for i in range(0, n, 12))
