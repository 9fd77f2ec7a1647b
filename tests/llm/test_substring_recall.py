import random

from lodeseek.llm import substring_dedup


def prose(rng: random.Random, n: int) -> list[str]:
    """Words with a full stop after each 6 to 18."""
    out, left = [], 0
    for _ in range(n):
        left = left or rng.randrange(6, 19)
        left -= 1
        out.append("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) + ("" if left else "."))
    return out


def test_windows_of_51_to_60_words_set_within_sentences(spark):
    rng = random.Random(12)
    rows, windows = [], {}
    for i in range(150):
        a, b = prose(rng, 300), prose(rng, 200)
        at, n = rng.randrange(20, 200), rng.randrange(51, 61)
        to = rng.randrange(20, 180)
        rows += [(i, " ".join(a)), (1000 + i, " ".join([*b[:to], *a[at : at + n], *b[to:]]))]
        windows[1000 + i] = a[at : at + n], b
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup(docs).collect()}
    assert all(got[i] == t for i, t in rows if i < 1000)
    left = {i: sum(w in set(got[i].split()) for w in words) / len(words) for i, (words, _) in windows.items()}
    assert sum(x <= 0.1 for x in left.values()) >= 0.97 * len(left)
    own = {i: sum(w in got[i].split() for w in set(b)) / len(set(b)) for i, (_, b) in windows.items()}
    assert min(own.values()) > 0.98
