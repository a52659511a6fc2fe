"""A market's pages read in turn: cycles over a folder, with interruptions, against a plain loop."""

import random

from lotwise.streaming.rotation import PAGE, follow_market, market_items, read_pages


def plain(pages):
    offers, cycle, done, refilling, last = {}, 1, 0, False, None
    for _, at, page, total, rows in pages:
        if last is not None and at - last > 10_800:
            refilling = True
        last = at
        for r in rows or []:
            if r[0] is not None:
                offers[r[0]] = (*r[1:], cycle)
        if not (total and page is not None and page < total and rows):
            offers = {k: v for k, v in offers.items() if v[-1] >= cycle}
            cycle, done, refilling = cycle + 1, done + 1, False
    return offers, {"cycle": cycle, "done": done, "complete": done > 0 and not refilling, "at": last}


def market(seed, cycles):
    r, seq, at, out = random.Random(seed), 0, 1_700_000_000, []
    for c in range(cycles):
        total = r.randrange(3, 9)
        for page in range(1, total + 1):
            at += r.choice([1, 2, 90]) if r.random() > 0.06 else 20_000
            rows = [(r.choice([f"o{r.randrange(40)}", None]) if r.random() < 0.9 else f"new{seq}", r.choice(["Seer", "Bat"]), r.choice([None, "gun"]), r.choice([None, 0.0, 1.5, 2.0]), r.randrange(9), r.choice(["s1", "s2", None]), r.choice([None, 30.0, 45.0])) for _ in range(r.randrange(1, 7))]
            if r.random() < 0.04:
                rows = []
            out.append((seq, at, page, r.choice([total] * 9 + [None]), rows))
            seq += 1
    return out


def test_cycles_with_interruptions_equal_a_loop(spark, tmp_path):
    pages = market(2, 9)
    folder = tmp_path / "in"
    folder.mkdir()
    assert follow_market(read_pages(spark, str(folder), 4), f"{tmp_path}/out")[1] == {"cycle": 1, "done": 0, "complete": False, "at": None}
    at = 0
    for size in (1, 6, 11, len(pages)):
        part, at = pages[at : at + size], at + size
        # a file for each page, in order
        spark.createDataFrame(part, PAGE).coalesce(1).sortWithinPartitions("seq").write.mode("append").option("maxRecordsPerFile", 1).parquet(str(folder))
        offers, progress = follow_market(read_pages(spark, str(folder), 4), f"{tmp_path}/out")
        want, wanted = plain(pages[:at])
        assert progress == wanted
        assert {r.id: (r.name, r.kind, r.price, r.quantity, r.seller, r.sold_30d, r.cycle) for r in offers.collect()} == want
    assert wanted["done"] > 5 and len(want) > 2
    items = {(r.name, r.kind): tuple(r)[2:] for r in market_items(offers).collect()}
    by = {}
    for name, kind, price, quantity, seller, sold, _ in want.values():
        by.setdefault((name, kind or ""), []).append((price, quantity, seller, sold))
    assert items == {k: (min((p for p, *_ in v if p), default=None), sum(x[1] for x in v), len({x[2] for x in v} - {None}), sum(round(x[3] * 7 / 30) for x in v if x[3] is not None) if any(x[3] is not None for x in v) else None) for k, v in by.items()}


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    from lotwise.streaming.rotation import OFFER, PROGRESS, turn

    pages = market(5, 3)
    start = spark.createDataFrame([], OFFER), spark.createDataFrame([(1, 0, False, None)], PROGRESS)
    one = spark.createDataFrame(pages[:7], PAGE)
    first = turn(one, *start)
    again = turn(one, *start)
    assert sorted(map(str, first[0].collect())) == sorted(map(str, again[0].collect())) and first[1].collect() == again[1].collect()
    nothing = turn(one.limit(0), *first)
    assert nothing[1].collect() == first[1].collect() and sorted(map(str, nothing[0].collect())) == sorted(map(str, first[0].collect()))
