"""Product state over polls against a fold in plain Python over all observations in order, with restarts and late rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lotwise.streaming import products
from lotwise.streaming.products import SEEN, current_products, follow_products, product_state

DAY = 86_400


def norm(s):
    return re.sub("[^a-z0-9]", "", (s or "").lower())


def plain(rows):
    """One dict of products of all markets, as a program that polls would hold it; written from the rules."""
    products, gone = {}, {}
    for market, poll, at, seq, source, name, link, price, lots, missing in sorted(rows, key=lambda r: (r[2], r[3])):
        for k in [k for k, p in products.items() if at - p["seen"] > 7 * DAY]:
            products.pop(k)
        for k in [k for k, t in gone.items() if at - t >= 3 * DAY]:
            gone.pop(k)
        own = None
        if link:
            slug = re.search("/product/([a-z0-9-]+)/", link)
            group = norm(slug[1])
            own = re.search("[0-9a-f-]{36}", link)[0]
            key = (market, own)
        else:
            group = norm(name)
            if not group:
                continue
            same = sorted((p["born"], k[1]) for k, p in products.items() if k[0] == market and p["group"] == group and not k[1].startswith("name:"))
            key = (market, same[0][1]) if same else (market, "name:" + group)
        if missing:
            p = products.get(key)
            if p and p.get("list_poll") != poll:
                p["misses"] = p.get("misses", 0) + 1
                p.setdefault("first_miss", at)
                p.update(price=None, lots=None, at=at)
                if key in gone or (p["misses"] >= 3 and at - p["first_miss"] >= DAY / 2):
                    products.pop(key)
                    gone[key] = at
            continue
        if key in gone:
            if price is not None or lots is not None or source == "page":
                gone.pop(key)
            elif key not in products and at - gone[key] < 6 * 3600:
                continue
        p = products.setdefault(key, {"born": at, "group": group, "price": None, "lots": None, "name": None, "at": None, "source": None})
        p["seen"] = at
        clear = lambda p: (p.pop("misses", 0), p.pop("first_miss", 0))
        if source == "page":
            clear(p)
        if name and (norm(name) == group or not p["name"]):
            p["name"] = name
        elif not p["name"]:
            p["name"] = slug[1].replace("-", " ")
        twin = products.pop((market, "name:" + group), None) if own else None
        if twin:
            if (twin["at"] or 0) > (p["at"] or 0):
                p.update({f: twin[f] for f in ("price", "lots", "at", "source") if twin[f] is not None})
            for mark in ("price_poll", "list_poll", "both_poll"):
                if mark in twin:
                    p[mark] = max(twin[mark], p.get(mark, -1))
        said = lots
        if source != "browser" and at - p.get("shown", -DAY) < 1800:
            price = None
            if p["shown_lots"]:
                lots = None
        if not own and price is not None and p.get("price_poll") == poll and p["price"] is not None:
            price = min(price, p["price"])
        if not own and p.get("both_poll") == poll:
            lots = None
        if price is not None or lots is not None:
            clear(p)
        raw = price
        if lots == 0:
            price = p["price"] = None
            p["at"] = at
        if price is not None:
            p.update(price=price, at=at, source=source, price_poll=poll)
            if source != "page":
                p["list_poll"] = poll
            if said is not None:
                p["both_poll"] = poll
        if lots is not None:
            p["lots"] = lots
            p["at"] = p["at"] or at
        if source == "browser" and (raw is not None or said is not None):
            p.update(shown=at, shown_lots=said is not None)
    return {(k[0], k[1]): (p["name"], p["price"], p["lots"], p["source"], p["at"], p["seen"], p.get("misses", 0)) for k, p in products.items()}


def observations(seed, count=1500):
    r = random.Random(seed)
    rows, at = [], 1_700_000_000
    for seq in range(count):
        at += r.choice([0, 1, 60, 900, 3600, 20_000]) if r.random() > 0.003 else 4 * DAY
        n = r.randrange(6)
        linked = r.random() < 0.6
        missing = r.random() < (0.5 if n == 1 else 0.15)
        link = f"https://m{r.randrange(2)}.x/product/ice-wing-{n}/{n:08x}-0000-0000-0000-{r.choice([0, 0, 0, 1]):012x}"
        name = f"Ice Wing {n}" if not linked else r.choice([None, f"ICE wing-{n}", "Other Name", ""])
        rows.append((r.choice(["a", "a", None]), at // 3600, at, seq, "page" if missing else r.choice(["list", "browser", "page", "json", "sitemap"]), name, link if linked or missing else None, None if missing else r.choice([None, 1.0, 2.5, 9.0]), None if missing else r.choice([None, None, 0, 3, 7]), r.choice([missing, missing or None])))
    return rows


def known(changes):
    return {(r.market, r.product): (r.name, r.price, r.lots, r.source, r.at, r.seen, r.misses) for r in current_products(changes).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_a_fold_in_order_with_a_restart(spark, tmp_path, seed):
    rows = observations(seed)
    rows.append((None, 0, rows[-1][2], 9_999, "list", "!!!", None, 1.0, 1, False))  # neither link nor name
    rows.append(("a", 0, None, 10_000, "list", "Ice Wing 1", None, 1.0, 1, False))  # no time
    times = sorted(r[2] for r in rows if r[2] is not None)
    parts = [[r for r in rows if (r[2] or 0) <= times[900]], [r for r in rows if times[900] < (r[2] or 0) <= times[1200]], [r for r in rows if (r[2] or 0) > times[1200]]]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for k, part in enumerate(parts):  # each part ends the stream; the next start goes on from its checkpoint
        random.Random(seed).shuffle(part)
        spark.createDataFrame(part, SEEN).repartition(3).sortWithinPartitions(F.xxhash64("seq")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = follow_products(source, f"{tmp_path}/out")
        want = plain([r for p in parts[: k + 1] for r in p if r[2] is not None])
        assert {x: v for x, v in known(changes).items() if x in want} == want
        # what only the stream still knows is what its watermark has not forgotten yet
        newest = max(v[5] for v in want.values())
        assert all(newest - v[5] > 7 * DAY for x, v in known(changes).items() if x not in want)
    statuses = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
    assert statuses.keys() >= {"known", "merged", "forgotten"} | ({"gone"} if seed == 1 else set()) and "late" not in statuses
    state, faults = product_state(spark, f"{tmp_path}/out")
    assert faults.count() == 0 and state.count() == len(known(changes))


def test_late_and_expired(spark, tmp_path):
    row = lambda at, seq, name, price: ("a", 0, at, seq, "list", name, None, price, 1, False)
    t = 1_700_000_000
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in")
    for batch in ([row(t, 1, "Seer", 5.0), row(t, 0, "Old", 1.0)], [row(t - 100, 2, "Seer", 9.0), row(t + 100, 3, "Seer", 6.0)], [row(t + 20 * DAY, 4, "New", 2.0)]):
        spark.createDataFrame(batch, SEEN).write.mode("append").parquet(f"{tmp_path}/in")
        changes = follow_products(source, f"{tmp_path}/out")
    assert {k[1]: v[1] for k, v in known(changes).items()} == {"name:new": 2.0}
    assert [(r.seq, r.price) for r in changes.where("status = 'late'").collect()] == [(2, 9.0)]
    assert {r.product for r in changes.where("status = 'forgotten'").collect()} == {"name:seer", "name:old"}
    assert product_state(spark, f"{tmp_path}/out")[0].count() == 1  # the state is bounded by what is remembered
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_faults_of_a_state(spark, monkeypatch):
    good = ("Seer", None, 1.0, 2, "list", 5, 5, 4, None, False, 0, None, None, None, None)
    rows = [("uuid", good), ("name:seer", good), ("b", (*good[:2], -1.0, *good[3:])), ("c", (*good[:4], None, *good[5:])), ("d", (*good[:7], 9, *good[8:]))]
    state = spark.createDataFrame([(("a", "seer"), (k,), v) for k, v in rows], f"key struct<market:string,key:string>, user_map_key struct<product:string>, user_map_value struct<{', '.join(':'.join(c.split()) for c in products.RECORD.split(', '))}>")

    class Reader:
        format = option = lambda self, *_: self
        load = lambda self, path: state

    monkeypatch.setattr(type(spark), "read", Reader())
    assert {r.product for r in product_state(spark, "x")[1].collect()} == {"name:seer", "b", "c", "d"}


def test_query_on_the_table(spark):
    got = {r.product: r for r in products.product_state_stream(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 15 and not any(k.startswith("name:") for k in got) and all(r.price is None or r.source for r in got.values())


def test_keys_are_not_told_twice(spark, capsys):
    rows = [("a", 0, 1, k, "list", n, li, 1.0, 1, False) for k, (n, li) in enumerate([("Seer", None), (None, "https://m/product/ice-wing/"), ("!!!", None), (None, ""), ("İ", None), ("", "x"), ("C. ", None), (None, None)])]
    seen = spark.createDataFrame([*rows, ("a", 0, None, 9, "list", "Seer", None, 1.0, 1, False)], SEEN)
    got = products.keyed(seen)
    assert {r.seq: r.key for r in got.collect()} == {0: "seer", 1: "icewing", 4: "i", 5: "link:x", 6: "chroma"}
    got.explain("formatted")
    filters = [x for x in capsys.readouterr().out.split("\n") if x.startswith("Condition")]
    assert filters and not any("regexp_" in x for x in filters)
