import random

from lodeseek.llm import edit_embedding as ee


def test_the_end_of_slow_walks_is_read():
    rng = random.Random(3)
    slow = 0
    for _ in range(300):
        t = "".join(rng.choice("etaoinshr ") for _ in range(rng.randrange(20, 60)))
        w = ee.Walk(t)
        if w.steps[-1] > 2 * len(t):
            slow += 1
            n, level, digits = w.fingerprint().split(".")
            assert int(n) == len(t) and level == "0" and len(digits) == w.steps[-1]
            assert digits[-1] == "0123456789abcdef"[w.nibbles[-1]]
    assert slow > 50
