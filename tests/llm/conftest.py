from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Seeded words, so that texts share nothing by chance."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(words))

    return make
