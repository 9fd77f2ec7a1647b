from lodeseek.llm import chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hashes string")


def duckdb_rows(rows):
    """The SQL's rows."""
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, hashes VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    return sorted((-1 if i is None else i, n, c, k, "-" if t is None else t) for i, n, c, k, t in con.sql(chat.ORACLE_SQL).fetchall())


def test_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "bye")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [("user", None)], None: [a, c]}  # rows without an id are conversations each for itself
    rows = [(i, k, r, t, "x") for i, ts in convs.items() for k, (r, t) in enumerate(ts)]
    got = {r["conv_id"]: r for r in chat.collapse(turns(spark, rows)).collect()}
    want = duckdb_rows(rows)
    assert sorted(tuple(r) for r in chat.collapse(turns(spark, rows)).fillna(-1, ["conv_id"]).fillna("-").collect()) == want
    lone = [r for r in chat.collapse(turns(spark, rows)).collect() if r["conv_id"] is None]
    assert sorted((r["n_turns"], r["kept"]) for r in lone) == [(1, False), (1, True)]
    assert {i for i, r in got.items() if i and r["kept"]} == {3, 5, 6}
    assert got[3]["copies"] == 2 and got[4]["copies"] == 0 and got[1]["rendered"] is None
    assert got[3]["rendered"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[6]["rendered"] == "<|user|>\n<|end|>\n"


def test_equal_rows_without_an_id(spark):
    rows = [(None, 0, "user", "same", "x")] * 5 + [(7, 0, "user", "other", "x"), (None, 3, "user", "other", "x")]
    got = sorted((r["conv_id"] or 0, r["kept"], r["copies"]) for r in chat.collapse(turns(spark, rows)).collect())
    assert got == [(0, False, 0)] * 5 + [(0, True, 5), (7, True, 2)]


def test_no_rows(spark):
    assert chat.collapse(turns(spark, [])).collect() == []
