import random

import pytest

VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "ré", "sa") for b in ("ba", "do", "fi", "gu", "pe", "ß")]


@pytest.fixture
def prose():
    """A function that makes seeded texts of n words."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(VOCAB) for _ in range(n))

    return make
