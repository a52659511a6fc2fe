"""Orders that the SQL leaves open at larger keys: the query gives one of its results, the same one whatever the order of the rows."""

import itertools

import pytest

from lotwise import registry

LINES = [(1, 200_000, 1), (1, 100_000, 2), (1, 7, 1), (2, 100_009, 3), (2, 200_009, 2), (2, 300_009, 1), (3, 100_004, 5), (3, 4, 6), (4, 7, None), (4, 4, None)]
PARTS = [(200_000, "Seer", 2), (100_000, "Gem", 2), (7, "Elder", 2), (100_009, "Wing", 4), (200_009, "Fang", 3), (300_009, "Luger", 8), (100_004, "Candy", 5), (4, "Saw", 5)]
EVENTS = [(2_005, 1, "view", "ab"), (1_005, 1, "click", "a"), (3_007, 1, "click", "b"), (5, 1, "error", "ba"), (9, 2, "view", "x"), (1_010, 2, "click", "x"), (11, 3, "view", None)]


@pytest.mark.parametrize("turn", [1, -1])
def test_ties_have_one_result(spark, tmp_path, turn):
    for name, rows, schema in (("lineitem", LINES, "l_orderkey long, l_partkey long, l_linenumber int"), ("part", PARTS, "p_partkey long, p_name string, p_size int"), ("events", EVENTS, "event_id long, user_id long, event_type string, props string")):
        spark.createDataFrame(rows[::turn], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = lambda name: dict(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    # card 1: one number for lines 1 and 2; card 2: for lines 3 and 1 that the popup knows, line 2 is unknown; a null number says nothing
    assert got("names_chosen") == {1: "Gem", 2: "Wing", 3: "Saw", 4: None}
    assert got("talkative_pass") == {1: "view", 2: "click", 3: None}


@pytest.mark.parametrize("turn", [1, -1])
def test_tied_pictures_have_one_result(spark, tmp_path, turn):
    parts = [(200_000, "Seer", 3), (100_000, "Gem", 3), (7, "Elder", 1)]  # without a caption, no icons
    for name, rows, schema in (("lineitem", LINES[:3], "l_orderkey long, l_partkey long, l_linenumber int"), ("part", parts, "p_partkey long, p_name string, p_size int")):
        spark.createDataFrame(rows[::turn], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = dict(map(tuple, registry.QUERIES["images_chosen"](spark, str(tmp_path)).collect()))
    # the card's name is that of its first line, the greater of Seer and Elder; no picture of that caption
    assert got == {1: "i/100000"}


PLAIN = [(200_000, "Seer", 3), (100_000, "Gem", 3), (7, "Elder", 1)]  # without a caption, no icons


@pytest.mark.parametrize(("name", "lines", "parts", "tied"), [
    ("images_chosen", LINES[:3], PLAIN, 1),
    ("names_chosen", LINES, PARTS, 3),
    ("talkative_pass", LINES, PARTS, 1),
])
def test_ties_have_one_of_the_results_of_the_sql(spark, tmp_path, name, lines, parts, tied):
    """The SQL differs from itself by the order of the rows, on tied rows alone; the query gives one of its results."""
    import duckdb

    told: dict = {}
    con = duckdb.connect()
    con.execute("SET threads = 1")
    tables = (("lineitem", lines, "l_orderkey long, l_partkey long, l_linenumber int"), ("part", parts, "p_partkey long, p_name string, p_size int"), ("events", EVENTS, "event_id long, user_id long, event_type string, props string"))
    for table, rows, schema in tables:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    for turn in itertools.product([1, -1], repeat=3):
        for (table, rows, schema), k in zip(tables, turn, strict=True):
            con.execute(f"CREATE OR REPLACE TABLE {table} ({schema})")
            con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows[::k])
        for key, value in con.execute(registry.ORACLES[name]).fetchall():
            told.setdefault(key, set()).add(value)
    got = dict(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got.keys() == told.keys() and all(v in told[k] for k, v in got.items())
    assert sum(len(v) > 1 for v in told.values()) == tied
