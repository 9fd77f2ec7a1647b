import random

from lodeseek.llm import edit_embedding as ee


def test_insertions_of_2_to_15_percent_against_brute_force(spark):
    rng = random.Random(14)
    words = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows, near = [], []
    for i in range(240):
        a = words(rng.randrange(30, 1000))
        at, n = rng.randrange(len(a)), int(len(a) * rng.uniform(0.02, 0.15))
        b = a[:at] + words(n)[:n] + a[at:]
        rows += [(i, a), (1000 + i, b)]
        if ee.likeness(ee.fingerprint(a), ee.fingerprint(b)) >= 0.8:
            near.append(i)
    got = {r["doc_id"]: r["group_id"] for r in ee.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 30 and sum(got[1000 + i] == i for i in near) >= 0.95 * len(near), (len(near), sum(got[1000 + i] == i for i in near))
    assert all(got[i] == i for i in range(240))


def test_recall_by_edit_rate(spark):
    """Random edits of single characters: what likeness calls near is found, small rates nearly always, and nothing else."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, rates = [], {}
    for n in range(160):
        text, rates[n] = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 400))), [0.001, 0.003, 0.01, 0.1][n % 4]
        edits = {i: rng.choice(("", "x", None)) for i in range(len(text)) if rng.random() < rates[n]}  # removed, replaced, doubled
        rows += [(2 * n, text), (2 * n + 1, "".join(c if i not in edits else c + c if edits[i] is None else edits[i] for i, c in enumerate(text)))]
    got = {r["doc_id"]: r["group_id"] for r in ee.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    alike = {n: ee.likeness(ee.fingerprint(texts[2 * n]), ee.fingerprint(texts[2 * n + 1])) >= 0.8 for n in rates}
    found = {n: got[2 * n] == got[2 * n + 1] for n in rates}
    share = lambda rate: sum(found[n] for n in rates if rates[n] == rate) / 40
    assert sum(found[n] for n in rates if alike[n]) >= 0.97 * sum(alike.values())
    assert share(0.001) >= 0.9 and share(0.001) >= share(0.003) >= share(0.01) >= share(0.1) and share(0.1) == 0
    assert all(got[i] in (i, i - 1) for i in got)
