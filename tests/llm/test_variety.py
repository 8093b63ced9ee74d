"""The variety rule votes on texts of any length."""

import random

import pyarrow as pa

from plumbline.llm import quality_rules
from plumbline.llm.text import Words


def test_variety_does_not_depend_on_length():
    rng = random.Random(2)
    shuffled = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (1990, 2000, 2001, 5000, 30_000)]
    varied = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) for n in (1990, 2001, 30_000)]
    at = quality_rules.RULES.index("variety")
    votes = quality_rules.measure(pa.array([*shuffled, None, *varied]))[1][:, at]
    assert votes.tolist() == [-1] * 5 + [0] + [1] * 3
    w = Words(pa.array([shuffled[1], "", shuffled[2]]), lower=False)
    a, none, b = quality_rules._repeats(w, w.hashes())
    assert none == 0 and abs(a - b) < 0.05
