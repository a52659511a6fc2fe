"""Sales of the last 48 hours as a stream: against a fold in order, with gaps, partial polls, restarts and late snapshots."""

import json
import random

from pyspark.sql import Row

from lotwise.streaming.history import SNAPSHOT, TOGETHER, StockHistory, follow_stock

HOUR = 3_600_000_000


def plain(rows, fresh=None):
    last, events, out = {}, {}, []
    for market, item, at, id_, stock, complete, interval in sorted(rows, key=lambda r: (r[2], r[3])):
        key, sold, listed = (market, item), None, None
        gap = fresh if fresh is not None else max(3 * (interval or 0), 1800)
        was = last.get(key)
        if was and was[2] and complete and was[1] is not None and stock is not None and at - was[0] <= gap * 1_000_000:
            sold, listed = max(0, was[1] - stock), max(0, stock - was[1])
            events.setdefault(key, []).append((at, sold, listed))
        last[key] = (at, stock, complete)
        near = [e for e in events.get(key, []) if at - 48 * HOUR <= e[0] <= at]
        out.append((market, item, id_, at, stock, sold, listed, sum(e[1] for e in near) if near else None, sum(e[2] for e in near) if near else None))
    return out


def text(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def snapshots(seed, count):
    r, at, rows = random.Random(seed), 1_700_000_000_000_000, []
    for k in range(count):
        at += r.choice([0, 60, 600, 2400, 5000]) * 1_000_000 if r.random() > 0.01 else 60 * HOUR
        rows.append((r.choice(["m", None]), r.choice(["a", "b", "c", None]), at, k, r.choice([None, 0, 3, 9, 14]) if r.random() < 0.3 else r.randrange(20), r.random() < 0.9, r.choice([300, 1200, None])))
    return rows


def test_stream_equals_a_fold_with_restarts(spark, tmp_path):
    rows = snapshots(1, 900)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cut = [0, 400, 650, 900]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        part = rows[a:b]
        while b < 900 and rows[b][2] == part[-1][2]:
            part, b = part[:-1], b - 1  # what is of one time comes together
        part = [x for x in part if x not in rows[:a]] if a else part
        random.Random(a).shuffle(part)
        spark.createDataFrame([*part, ("m", "a", None, 1, 1, True, 1)], SNAPSHOT).repartition(3, "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes, late = follow_stock(source, f"{tmp_path}/out")
    given = {r.id for r in changes.collect()}
    assert len(given) > 880 and late.count() == 0
    assert text(changes.collect()) == text(plain([r for r in rows if r[3] in given]))
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/out/state")
    assert 0 < state.count() <= 8


def test_late_snapshots_and_cleared_state(spark, tmp_path):
    t = 1_700_000_000_000_000
    row = lambda item, hours, id_, stock: ("m", item, t + int(hours * HOUR), id_, stock, True, 7_200)
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SNAPSHOT).parquet(f"{tmp_path}/in")
    batches = [[row("a", 0, 1, 10), row("a", 2, 2, 7), row("b", 0, 3, 5)], [row("a", 1, 4, 99), row("a", 4, 5, 9)], [row("c", 24 * 30, 6, 1)], [row("a", 3, 7, 50), row("b", 24 * 29.9, 8, 1), row("a", 24 * 29.9, 9, 2)]]
    for b in batches:
        spark.createDataFrame(b, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes, late = follow_stock(source, f"{tmp_path}/out")
    got = {r.id: (r.sold, r.listed, r.sold_kept, r.listed_kept) for r in changes.collect()}
    assert got[2] == (3, 0, 3, 0) and got[5] == (0, 2, 3, 2)
    # ids 7 to 9 come a month later: the state of a and b is cleared, so 7 is a first one though it is very late, and nothing is lost
    assert sorted(r.id for r in late.collect()) == [4] and set(got) == {1, 2, 3, 5, 6, 7, 8, 9}
    assert got[7] == got[8] == got[9] == (None, None, None, None)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/out/state")
    assert {r.item for r in state.select("key.item").collect()} == {"a", "b", "c"}


class Calls:
    """A handle and its state, which count what a processor asks of them."""

    def __init__(self):
        self.value, self.calls = None, []

    def __getattr__(self, name):
        def call(*x):
            self.calls.append(name)
            if name == "update":
                self.value = x[0]
            return self if name.endswith("State") else self.value if name == "get" else False if name == "exists" else iter(()) if name == "clear" else None

        return call


def test_few_calls_of_the_state_and_rows_in_parts():
    state, one = Calls(), StockHistory()
    one.init(state)
    state.calls.clear()
    rows = [Row(market="m", item="a", row=json.dumps([k * 60_000_000, k, None if k == 7 else k % 5, 1, 300])) for k in range(2 * TOGETHER + 1)]
    got = [json.loads(r.told) for r in one.handleInputRows(("m", "a"), iter(rows[::-1]), None)]
    assert state.calls == ["get", "registerTimer", "update"] and [len(x) for x in got] == [TOGETHER, TOGETHER, 1]
    want = plain([("m", "a", k * 60_000_000, k, None if k == 7 else k % 5, True, 300) for k in range(2 * TOGETHER + 1)])
    assert [tuple(x) for part in got for x in part] == [(w[2], *w[3:], 0) for w in want]
