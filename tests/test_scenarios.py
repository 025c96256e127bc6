"""Small hand-made cases of the operators."""

import math
import random
from collections import OrderedDict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barline.functions import ordered, scalars, schema
from barline.operators import backtest, book, indicators, portfolio, risk, stats, store
from barline.sources import cold, klines, synthetic

BAR = dict(open=1.0, high=2.0, low=0.5, close=1.5, volume=100.0)


def candles(spark, rows, **more):
    """Rows of (symbol, ts) or (symbol, ts, changed fields), in order of arrival."""
    made = []
    for seq, (symbol, ts, *rest) in enumerate(rows):
        bar = BAR | more | (rest[0] if rest else {})
        made.append((seq, symbol, ts, *(float(bar[f]) for f in schema.FIELDS)))
    return spark.createDataFrame(made, schema.CANDLE)


def values(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "ts, start, end, n",
    [([100, 200, 300], 100, 200, 2), ([1, 2, 3, 4, 5], 2, 4, 3), ([1, 2, 3, 4, 5], 10, 5, 0), ([1, 2, 3, 4, 5], 100, 200, 0), ([1, 2, 2, 2, 3], 2, 2, 3)],
)
def test_range_is_inclusive_and_keeps_duplicates(spark, ts, start, end, n):
    assert store.time_range(candles(spark, [("A", t) for t in ts]), "A", start, end).count() == n


def test_bounded_range(spark):
    ten = candles(spark, [("A", t) for t in range(10)])
    assert values(store.bounded_range(ten, "A", 0, 9, 3), "ts") == [0, 1, 2]
    assert store.bounded_range(ten, "A", 0, 9, 0).count() == 0
    with pytest.raises(ValueError):
        store.bounded_range(ten, "A", 0, 9, -1)


def test_ring_keeps_the_latest(spark):
    placed = store.residency(candles(spark, [("A", t) for t in range(1, 8)]), 4)
    live = store.hot_scan(placed, 4, 4)
    assert sorted(values(live, "ts")) == [4, 5, 6, 7]
    assert sorted(values(store.last_n(live, 2), "ts")) == [6, 7]
    assert store.last_n(live, 0).count() == 0


def test_late_rows_compare_with_the_row_before(spark):
    placed = store.residency(candles(spark, [("A", t) for t in (10, 20, 15, 17)]), 1)
    assert values(store.late_rows(placed), "ts") == [15]
    assert sorted(values(indicators.accepted(placed), "ts")) == [10, 20]


def test_least_recently_appended_goes(spark):
    placed = store.residency(candles(spark, [("A", 1), ("B", 2), ("A", 3), ("C", 4)]), 2)
    assert sorted(values(store.hot_symbols(placed, 2), "symbol")) == ["A", "C"]
    assert values(store.cold_rows(placed, 2), "symbol", "ts") == [("B", 2)]


def test_hot_and_cold_make_the_whole_history(spark):
    rows = [("BTC", t) for t in range(5)] + [("ETH", 100)] + [("BTC", t) for t in range(5, 10)]
    placed = store.residency(candles(spark, rows), 1)
    both = store.merged(store.hot_scan(placed, 1), store.cold_rows(placed, 1)).where("symbol = 'BTC'")
    assert sorted(values(both, "ts")) == list(range(10))


def test_hot_wins(spark):
    hot, old = candles(spark, [("A", 100, {"close": 2.0})]), candles(spark, [("A", 100, {"close": 1.0})])
    assert values(store.merged(hot, old), "close") == [2.0]


@pytest.mark.parametrize("room, rows", [(1, 7), (2, 16), (3, 9), (5, 64)])
def test_replay_equals_an_ordered_dict(spark, room, rows):
    rng = random.Random(room)
    log = [rng.choice("ABCDEFGH") for _ in range(300)]
    got = {r["seq"]: (r["inserted"], r["victim"]) for r in store.replay(candles(spark, [(s, 1) for s in log]), room, rows).collect()}
    held = OrderedDict()
    for seq, symbol in enumerate(log):
        inserted, victim = symbol not in held, None
        if inserted and len(held) == room:
            victim = held.popitem(last=False)[0]
        held[symbol] = None
        held.move_to_end(symbol)
        assert got[seq] == (inserted, victim)


def test_invalid_candles_are_told(spark):
    bad = [("A", -1)] + [("A", 1, {f: v}) for f, v in zip(schema.FIELDS, (math.nan, math.inf, -math.inf, math.nan, math.inf), strict=True)]
    good, rejected = store.ingest(candles(spark, bad + [("A", 0)]))
    assert good.count() == 1
    assert sorted(values(rejected, "fault")) == sorted(["ts", *schema.FIELDS])
    assert store.snapshot(candles(spark, bad), 2).first().asDict() == dict(appends=0, invalid=6, out_of_order=0, evictions=0, spill_bytes=0, symbols=0)


def test_ordered_functions_do_not_depend_on_ranges(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.randrange(100)) for k, s in enumerate(rng.choice("AAAAB") for _ in range(200))]
    df = spark.createDataFrame(rows, "symbol string, seq long, v long")
    for size in (3, 10, 1000):
        got = {r["seq"]: r for r in ordered.numbered(ordered.running(df, ["symbol"], ["seq"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, size), ["symbol"], ["seq"], "n", size).collect()}
        for symbol in "AB":
            before = []
            for s, k, v in rows:
                if s == symbol:
                    assert (got[k]["s"], got[k]["m"], got[k]["n"]) == (sum(before), max(before, default=None), len(before) + 1)
                    before.append(v)
        counted = ordered.numbered(df, ["symbol"], ["seq"], "n", size)
        framed = ordered.framed(counted, ["symbol"], "n", 4, lambda w: {"t": F.sum("v").over(w.rowsBetween(-4, 0))}, size)
        for r in framed.collect():
            own = [v for s, k, v in rows if s == r["symbol"] and k <= r["seq"]]
            assert r["t"] == sum(own[-5:])


@pytest.mark.parametrize("value", ["CASE WHEN id = 7 THEN 1000000000000 ELSE id END", "5", "CASE WHEN id % 3 = 0 THEN 0 ELSE id * id END"])
def test_ranges_hold_equally_many(spark, value):
    """One far value, all values equal, and a third of them equal."""
    rows = spark.range(100_000).select(F.lit("A").alias("key"), F.expr(f"CAST({value} AS BIGINT)").alias("value"), "id")
    cut = ordered.with_range(rows, ["key", "value", "id"], ordered.spread(rows, ["key"]), 5000)
    sizes = [r["count"] for r in cut.groupBy("_range").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 2 * 5000
    assert ordered.numbered(rows, ["key"], ["value", "id"], rows=5000).agg(F.count_distinct("n"), F.max("n")).first()[:] == (100_000, 100_000)
    ends = cut.groupBy("_range").agg(F.min(F.struct("value", "id")).alias("low"), F.max(F.struct("value", "id")).alias("high")).orderBy("_range").collect()
    assert all(a["high"] < b["low"] for a, b in zip(ends, ends[1:], strict=False))


def test_sma(spark):
    four = candles(spark, [("A", t, {"close": t}) for t in (1, 2, 3, 4)])
    assert values(indicators.rolling_sma(four, 3).orderBy("seq"), "sma") == [None, None, 2.0, 3.0]
    assert values(indicators.rolling_sma(four, 0), "sma") == [None] * 4


@pytest.mark.parametrize("short, long", [(1, 2), (2, 3), (3, 2), (4, 4), (0, 3)])
def test_crossovers_equal_a_sequential_strategy(spark, short, long):
    rng = random.Random(short * 10 + long)
    rows = [("A", t + rng.choice([0, 0, 0, -5]), {"close": float(rng.randrange(1, 6))}) for t in range(1, 120)]
    got = [(r["n"], r["side"]) for r in indicators.sma_crossover(candles(spark, rows), short, long).orderBy("n").collect()]
    want, closes, last, before = [], [], -100, None
    for _, ts, bar in rows:
        if ts <= last or min(short, long) < 1:
            continue
        last = ts
        closes.append(bar["close"])
        s = sum(closes[-short:]) / short if len(closes) >= short else None
        l = sum(closes[-long:]) / long if len(closes) >= long else None
        if len(closes) >= max(short, long + 1) + 1:
            now, was = round(s - l, 9), round(before[0] - before[1], 9)
            if was <= 0 < now or was >= 0 > now:
                want.append((len(closes), "B" if now > 0 else "S"))
        before = (s, l)
    assert got == want


@pytest.mark.parametrize("variant, realized", [({}, 22.573386), ({"ties_long": True, "close_at": "close"}, 22.150060)])
def test_paper_strategy_on_sine_candles(spark, variant, realized):
    trades = backtest.sma_paper_trades(synthetic.sine_candles(spark, 200), **variant)
    assert trades.count() == 6
    assert abs(trades.agg(F.sum("pnl")).first()[0] - realized) < 1e-6


def test_monotonic_clock(spark):
    rows = candles(spark, [("A", t) for t in (5, 5, 3, 10, 2)])
    assert values(indicators.monotonic_ts(rows, ["symbol"]).orderBy("seq"), "out_ts") == [5, 6, 7, 10, 11]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(range(200))], "k string, id long, v long")
    assert tuple(stats.latency_percentiles(df, ["k"], "v", "id").first()) == ("a", 200, 0, 99, 100, 198, 199, 199)


def test_cold_spills_overlap_and_newest_wins(spark, tmp_path):
    path = f"file://{tmp_path}/cold"
    for spill, (ts, close) in enumerate([((0, 4, 10), 1.0), ((0, 6, 10), 2.0)]):
        cold.write(candles(spark, [("A/B", t, {"close": close}) for t in ts]).withColumn("spill", F.lit(spill).cast("long")), path)
    cold.write(candles(spark, [("A_B", 4)]).withColumn("spill", F.lit(0).cast("long")), path)
    got = cold.query(cold.read(spark, path), "A/B", 0, 10)
    assert values(got, "ts", "close") == [(0, 2.0), (4, 1.0), (6, 2.0), (10, 2.0)]
    plan = cold.read(spark, path).where("symbol = 'A_B' AND ts >= 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan and "GreaterThanOrEqual(ts,3)" in plan


def test_cold_ranges_prune_by_symbol(spark, tmp_path):
    path = f"file://{tmp_path}/cold"
    for spill in (1, 2):
        rows = candles(spark, [(s, t, {"close": float(spill)}) for s in ("A/B", "A_B", "é") for t in range(4)])
        cold.write(rows.where(f"ts < {6 - 2 * spill}").withColumn("spill", F.lit(spill).cast("long")), path, folders=False)
    assert values(cold.query(cold.read(spark, path), "A/B", 1, 9), "symbol", "ts", "close") == [("A/B", 1, 2.0), ("A/B", 2, 1.0), ("A/B", 3, 1.0)]
    assert cold.read(spark, path).columns == cold.read(spark, path, checked=True).columns == [*schema.BAR.names, "spill", "symbol"]
    assert cold.read(spark, path, checked=True).count() == 18
    assert "EqualTo(symbol,A_B)" in cold.read(spark, path).where("symbol = 'A_B'")._jdf.queryExecution().executedPlan().toString()
    cold.write(rows, path)
    with pytest.raises(Exception, match="(?i)conflict"):
        cold.read(spark, path).count()


def test_file_gate(spark, tmp_path):
    folder = tmp_path / "gate" / "symbol=A"
    folder.mkdir(parents=True)
    full = {"ts": pa.array([1], pa.int64())} | {f: pa.array([1.0]) for f in schema.FIELDS}
    cases = {
        "v0": (full, {}),
        "v1": (full, {"brand": cold.BRAND, "schema_version": "1"}),
        "v999": (full, {"brand": cold.BRAND, "schema_version": "999"}),
        "other": (full, {"brand": "x", "schema_version": "1"}),
        "half": (full, {"brand": cold.BRAND}),
        "short": ({k: v for k, v in full.items() if k != "volume"}, {}),
        "wrong": (full | {"close": pa.array(["x"])}, {}),
        "more": (full | {"extra": pa.array([7])}, {}),
    }
    for name, (columns, metadata) in cases.items():
        pq.write_table(pa.table(columns).replace_schema_metadata(metadata), folder / f"{name}.parquet")
    (folder / "torn.parquet").write_bytes(b"PAR1 nothing")
    path = f"file://{tmp_path}/gate"
    faults = {r["path"].rsplit("/", 1)[1].split(".")[0]: r["fault"] for r in cold.check_files(spark, path).collect()}
    assert {n for n, f in faults.items() if f is None} == {"v0", "v1", "more"}
    assert faults["v999"] == "NewerVersion" and faults["other"] == faults["half"] == "UnknownSchema"
    assert faults["short"] == "MissingColumn volume" and faults["wrong"] == "WrongColumnType close" and faults["torn"].startswith("Unreadable")
    assert cold.read(spark, path, checked=True).count() == 3


def orders(spark, rows):
    """Rows of (symbol, side, kind, price, qty)."""
    return spark.createDataFrame([(seq, s, side, kind, p, float(q), seq) for seq, (s, side, kind, p, q) in enumerate(rows)], "seq long, symbol string, side string, kind string, price double, qty double, ts long")


def submit(b, *args):
    return [(e[0], e[5] or e[4]) for e in b.submit(*args)]


def test_book_rests_what_is_left():
    b = book.Book()
    b.submit(1, "S", "LIMIT", 50000.0, 0.5)
    assert submit(b, 2, "B", "LIMIT", 50000.0, 1.0) == [("FILL", 0.5), ("FILL", 0.5)]
    assert b.sides["B"].best() == book.key_of(50000.0) and b.sides["S"].best() is None


def test_book_market_walks_levels_in_order():
    b = book.Book()
    b.submit(1, "S", "LIMIT", 50000.0, 0.5)
    b.submit(2, "S", "LIMIT", 49900.0, 0.5)
    events = b.submit(3, "B", "MARKET", None, 1.0)
    assert [(e[1], e[3]) for e in events] == [(3, 49900.0), (2, 49900.0), (3, 50000.0), (1, 50000.0)]
    assert submit(b, 4, "B", "MARKET", None, 1.0) == [("CANCEL", "MarketNoLiquidity")]


def test_book_ioc_and_fok():
    b = book.Book()
    b.submit(1, "S", "LIMIT", 100.0, 0.3)
    assert submit(b, 2, "B", "FOK", 100.0, 1.0) == [("CANCEL", "FokNoFill")]
    assert submit(b, 3, "B", "IOC", 100.0, 1.0) == [("FILL", 0.3), ("FILL", 0.3), ("CANCEL", "IocRemainder")]
    for bad in ((math.nan, 1.0), (100.0, 0.0), (1e15, 1.0), (-1.0, 1.0)):
        assert submit(b, 4, "B", "LIMIT", *bad) == [("CANCEL", "InvalidOrder")]


@pytest.mark.parametrize("q", [1.0, 1e3, 1e6])
@pytest.mark.parametrize("kind", ["FOK", "MARKET"])
def test_book_leaves_no_dust(q, kind):
    b = book.Book()
    for i in range(3):
        b.submit(i, "S", "LIMIT", 100.0 + i, q / 3)
    events = b.submit(9, "B", kind, 200.0 if kind == "FOK" else None, q)
    assert [e[0] for e in events] == ["FILL"] * 6


def test_replay_keeps_quantities(spark):
    rng = random.Random(3)
    rows = [(rng.choice("XY"), rng.choice("BS"), rng.choice(["LIMIT", "LIMIT", "MARKET", "IOC", "FOK"]), None, rng.randrange(1, 9)) for _ in range(400)]
    rows = [(s, side, kind, None if kind == "MARKET" else float(rng.randrange(95, 106)), q) for s, side, kind, _, q in rows]
    events = book.replay(orders(spark, rows)).collect()
    filled, last = {}, {}
    for e in events:
        if e["event"] == "FILL":
            filled[e["order_id"]] = filled.get(e["order_id"], 0.0) + e["qty"]
    for n, (symbol, side, kind, price, qty) in enumerate(rows):
        assert filled.get(n, 0.0) <= qty * (1 + 1e-9)
        if kind == "FOK":
            assert filled.get(n, 0.0) in (0.0, pytest.approx(qty))
    takers = [e for e in events if e["event"] == "FILL" and e["order_id"] == e["seq"]]
    makers = [e for e in events if e["event"] == "FILL" and e["order_id"] != e["seq"]]
    assert sum(e["qty"] for e in takers) == sum(e["qty"] for e in makers) and takers
    for e in takers:  # no worse than the limit
        price = rows[e["seq"]][3]
        assert price is None or (e["price"] <= price if e["side"] == "B" else e["price"] >= price)


def matched(rows):
    """Events of each order by a plain rule: of all resting orders of the other side the best by price, then arrival, gives what it has."""
    resting, told = [], []
    for n, (symbol, side, kind, price, qty) in enumerate(rows):
        def fits(o, price=price, symbol=symbol, side=side):
            return o["symbol"] == symbol and o["side"] != side and (price is None or (o["price"] <= price if side == "B" else o["price"] >= price))

        def refuse(why, n=n, symbol=symbol):
            told.append((symbol, n, "CANCEL", n, None, None, None, why))

        if not qty > 0 or not math.isfinite(qty) or (price is None and kind == "LIMIT") or (price is not None and not (math.isfinite(price) and 0 < price)):
            refuse("InvalidOrder")
            continue
        if kind == "FOK" and sum(o["left"] for o in resting if fits(o)) < qty:
            refuse("FokNoFill")
            continue
        left = qty
        while left and (others := [o for o in resting if fits(o)]):
            best = min(others, key=lambda o: (o["price"] if side == "B" else -o["price"], o["n"]))  # noqa: B023
            size = min(left, best["left"])
            left -= size
            best["left"] -= size
            told += [(symbol, n, "FILL", n, side, best["price"], size, None), (symbol, n, "FILL", best["n"], best["side"], best["price"], size, None)]
            resting = [o for o in resting if o["left"]]
        if left and kind == "LIMIT":
            resting.append(dict(n=n, symbol=symbol, side=side, price=price, left=left))
        elif left and kind != "FOK":
            refuse("MarketNoLiquidity" if kind == "MARKET" else "IocRemainder")
    return told


@pytest.mark.parametrize("seed", [4, 5])
def test_replay_equals_a_plain_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(1500):
        kind = rng.choice(["LIMIT", "LIMIT", "LIMIT", "MARKET", "IOC", "FOK"])
        price = None if kind == "MARKET" or rng.random() < 0.1 else rng.choice([math.nan, -1.0]) if rng.random() < 0.03 else rng.randrange(380, 421) / 4
        rows.append((rng.choice("XYZ"), rng.choice("BS"), kind, price, rng.choice([0, *range(1, 12)])))
    got = {}
    for e in book.replay(orders(spark, rows)).collect():
        got[e["seq"], e["ord"]] = tuple(e[c] for c in ("symbol", "seq", "event", "order_id", "side", "price", "qty", "reason"))
    assert [got[k] for k in sorted(got)] == matched(rows)


def test_order_and_signal_faults(spark):
    df = spark.createDataFrame([(math.nan, 1.0), (1.0, 0.0), (1e15, 1.0), (None, 1.0), (5.0, 1.0), (0.0, 1.0), (math.nan, -1.0)], "p double, q double")
    assert values(df.select(scalars.order_fault(F.col("q"), F.col("p")).alias("f")), "f") == ["PriceNotFinite", "QuantityInvalid", "PriceOutOfRange", None, None, "PriceNotPositive", "QuantityInvalid"]
    names = spark.createDataFrame([("x" * 23,), ("x" * 24,), ("x" * 22 + "é",)], "s string")
    assert values(names.select(scalars.signal_fault(F.col("s"), F.lit(0.0), F.lit(1.0)).alias("f")), "f") == [None, "SymbolTooLong", "SymbolTooLong"]
    assert values(names.select(scalars.lossy_symbol(F.col("s")).alias("f")), "f") == ["x" * 23, "x" * 23, ""]


def test_paper_orders(spark):
    bar = dict(open=50000.0, high=51000.0, low=49000.0, close=50500.0)
    given = orders(spark, [("A", "B", "MARKET", None, 1), ("A", "B", "LIMIT", 49500.0, 1), ("A", "B", "LIMIT", 48000.0, 1), ("A", "B", "IOC", 48000.0, 1), ("A", "S", "FOK", 60000.0, 1), ("A", "B", "LIMIT", math.nan, 1), ("B", "B", "MARKET", None, 1)])
    bars = candles(spark, [("A", 7, bar)]).withColumn("seq", F.lit(100).cast("long"))
    got = {r["order_id"]: (r["event"], r["price"], r["reason"]) for r in backtest.paper_events(given, bars).collect()}
    assert got == {1: ("FILL", 50000.0, None), 2: ("FILL", 49500.0, None), 4: ("CANCEL", None, "IocRemainder"), 5: ("CANCEL", None, "FokNoFill")}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_paper_events_equal_a_sequential_engine(spark, block):
    rng = random.Random(block)
    asked, bars, want = [], [], {}
    pending, n = [], 0
    for seq in range(200):
        symbol = rng.choice("AB")
        if rng.random() < 0.4:
            kind = rng.choice(["LIMIT", "MARKET", "IOC", "FOK"])
            order = (seq, symbol, rng.choice("BS"), kind, None if kind == "MARKET" else float(rng.randrange(80, 120)), 1.0, seq)
            asked.append(order)
            n += 1
            pending.append((n, *order))
        else:
            o = float(rng.randrange(90, 110))
            low, high = o - rng.randrange(12), o + rng.randrange(12)
            bars.append((seq, symbol, seq, o, high, low, o, 1.0))
            keep = []
            for p in pending:
                i, _, s, side, kind, price, _, _ = p
                hit = kind == "MARKET" or (low <= price if side == "B" else high >= price)
                if s != symbol or (kind == "LIMIT" and not hit):
                    keep.append(p)
                elif hit:
                    want[i] = o if kind == "MARKET" else (min(price, o) if side == "B" else max(price, o))
                else:
                    want[i] = None
            pending = keep
    given = spark.createDataFrame(asked, "seq long, symbol string, side string, kind string, price double, qty double, ts long")
    got = {r["order_id"]: r["price"] for r in backtest.paper_events(given, spark.createDataFrame(bars, schema.CANDLE), block).collect()}
    assert got == want


@pytest.mark.parametrize(
    "fills, position, cost, realized, cash",
    [
        ([("B", 1, 50000), ("S", 1, 51000)], 0, 0, 1000, 1000),
        ([("S", 2, 100)], -2, 100, 0, 200),
        ([("S", 1, 100), ("S", 1, 110)], -2, 105, 0, 210),
        ([("B", 1, 100), ("S", 3, 110)], -2, 110, 10, 230),
        ([("S", 1, 100), ("B", 3, 90)], 2, 90, 10, -170),
        ([("B", 1 / 3, 100), ("B", 1 / 3, 100), ("B", 1 / 3, 100), ("S", 1.0, 100)], 0, 0, 0, 0),
    ],
)
def test_account(fills, position, cost, realized, cash):
    account = portfolio.Account()
    for side, q, p in fills:
        account.apply(1.0 if side == "B" else -1.0, float(q), float(p))
    assert (account.position, account.cost) == (position, cost)
    assert (account.realized, account.cash) == (pytest.approx(realized, abs=1e-9), pytest.approx(cash, abs=1e-9))


def test_unrealized_and_total(spark):
    held = spark.createDataFrame([("A", -1.0, 100.0, 5.0, 100.0, 1), ("B", 1.0, 1.0, 0.0, 0.0, 1)], portfolio.POSITIONS)
    marks = spark.createDataFrame([("A", 90.0)], "symbol string, mark double")
    assert portfolio.total_pnl(held, marks, 0.0).first().asDict() == dict(realized=5.0, unrealized=10.0, cash=100.0, total=15.0)


@pytest.mark.parametrize(
    "position, side, qty, verdict",
    [(6.0, "B", 5.0, "PositionLimitExceeded"), (-8.0, "S", 5.0, "PositionLimitExceeded"), (0.0, "B", 10.0, "InvalidQty"), (0.0, "B", 0.0, "InvalidQty"), (5.0, "B", 5.0, "Accepted"), (0.0, "B", None, "InvalidQty")],
)
def test_risk_gates(position, side, qty, verdict):
    executor = risk.Executor(risk.Gates(5.0, 10.0, 100))
    executor.position = position
    assert executor.judge(side, qty, 0) == verdict


def test_rate_restarts_at_an_attempt():
    executor = risk.Executor(risk.Gates(5.0, 100.0, 3, 1000))
    assert [executor.judge("B", 1.0, t) for t in (500, 600, 700, 800, 1499, 1500, 1600)] == ["Accepted"] * 3 + ["RateLimitExceeded"] * 2 + ["Accepted"] * 2


def test_klines(spark):
    k = '{"stream":"x","data":{"k":{"t":5,"o":"1.5","h":"2","l":"1","c":"1","v":"3","x":%s,"s":"btcusdt","i":"1m","more":1}}}'
    rows = [(k % "true",), (k % "false",), ("{",), (k.replace('"1.5"', '"?"') % "true",), (None,)]
    got = klines.decode(spark.createDataFrame(rows, "value string")).drop("value").collect()
    assert [tuple(r) for r in got] == [("BTCUSDT:1m", 5, 1.5, 2.0, 1.0, 1.0, 3.0)]
    assert klines.subscription_url("h", [("BTCUSDT", "1m"), ("ETHUSDT", "5m")]) == "wss://h/stream?streams=btcusdt@kline_1m/ethusdt@kline_5m"
    with pytest.raises(ValueError):
        klines.subscription_url("h", [])


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(scalars.escape_symbol(F.lit(s))) for s in ("BTC/USDT:1m", "ETH-USD")] == ["BTC_USDT_1m", "ETH-USD"]
    assert [value(scalars.load_position(F.lit(s))) for s in (None, "garbage", "NaN", "1.25")] == [0.0, 0.0, 0.0, 1.25]
    assert [value(scalars.parse_cache_size(F.lit(s))) for s in ("32K", "8M", "512", "x")] == [32768, 8388608, 512, None]
    assert [value(scalars.ring_capacity(F.lit(b), F.lit(f), F.lit(n))) for b, f, n in ((4 << 20, 1 / 3, 10), (1 << 10, 1.0, 0), (1 << 40, 1.0, 1))] == [2912, 256, 1_000_000]
    assert value(scalars.price_key(F.lit(50000.5))) == 5_000_050_000_000


def test_walk_is_repeatable(spark):
    a, b = (synthetic.walk_candles(spark, 50).collect() for _ in range(2))
    assert a == b and all(r["low"] <= min(r["open"], r["close"]) and r["high"] >= max(r["open"], r["close"]) for r in a)


def test_options():
    from barline.functions.options import StoreOptions, StrategyOptions

    assert StoreOptions.from_hardware(10, 4 << 20).ring_capacity == 2912
    assert StoreOptions.from_hardware(0, 1 << 10, 9.0).ring_capacity == 256
    assert StrategyOptions.from_settings({"SMA_SHORT": "5", "SMA_QTY": "x"}) == StrategyOptions(short=5)


def test_gates_come_from_settings():
    from barline.operators.risk import Gates

    assert Gates.from_settings({"RISK_MAX_QTY": "2.5", "RISK_BUCKET": "60", "RISK_MAX_POSITION": "", "SMA_MAX_QTY": "9"}) == Gates(max_qty=2.5, bucket=60)


def test_store_from_options(spark, tmp_path):
    from barline.functions.options import StoreOptions

    log = candles(spark, [(s, t, {}) for t, s in enumerate("AABBBCA")] + [("D", 9, {"close": float("nan")})])
    hot, cold = store.opened(log, StoreOptions(max_symbols=2, ring_capacity=2, data_dir=f"file://{tmp_path}/cold"))
    assert sorted((r["symbol"], r["ts"]) for r in hot.collect()) == [("A", 6), ("C", 5)]
    assert sorted((r["symbol"], r["ts"]) for r in cold.collect()) == [("A", 0), ("A", 1), ("B", 3), ("B", 4)]
    assert store.opened(log, StoreOptions(max_symbols=2))[1] is None


def test_rings_go_on_over_batches(spark, tmp_path):
    from barline.streaming import live

    out = f"file://{tmp_path}/out"
    for part in (range(0, 50), range(100, 140), range(50, 100)):
        rows = [("AB"[t % 2], t, {"close": float(t)}) for t in part]
        candles(spark, rows).withColumn("seq", F.col("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = live.rings(spark.readStream.schema(schema.CANDLE).parquet(f"file://{tmp_path}/in"), 3)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check")
        writer.trigger(availableNow=True).start().awaitTermination()
    got = live.latest_rings(spark.read.schema(live.RING).parquet(out)).collect()
    assert sorted((r["symbol"], r["seq"], r["close"]) for r in got) == [("A", t, float(t)) for t in (134, 136, 138)] + [("B", t, float(t)) for t in (135, 137, 139)]


def test_stream_state_goes_on_over_batches(spark, tmp_path):
    """Two runs over one checkpoint give what one pass over all rows gives."""
    from barline.streaming import live

    rng = random.Random(2)
    rows = candles(spark, [("A", t, {"close": float(rng.randrange(1, 9))}) for t in range(120)])
    want = sorted(map(tuple, indicators.sma_crossover(rows, 3, 5).collect()))
    out = f"file://{tmp_path}/out"
    for part in ("seq < 50", "seq >= 50"):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = live.crossovers(live.counted(spark.readStream.schema(schema.CANDLE).parquet(f"file://{tmp_path}/in"), "c"), 3, 5)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["observedMetrics"]["c"]["invalid"] == 0
    got = spark.read.schema(live.CROSSING).parquet(out)
    assert sorted(map(tuple, got.collect())) == want and want


def test_rows_of_a_batch_are_put_in_order_in_bounded_memory():
    """Ten times the rows, in runs of 10,000: what is held at once grows much less."""
    import tracemalloc

    import pandas as pd

    from barline.streaming import live

    def parts(n):
        for at in range(0, n, 500):
            seq = [(i * 7919) % n for i in range(at, at + 500)]
            yield pd.DataFrame({"seq": seq, "side": ["BS"[s % 2] for s in seq]})

    peaks = []
    for n in (20_000, 200_000):
        tracemalloc.start()
        rows = 0
        for row in live._in_order(parts(n), 10_000):
            assert (row.seq, row.side) == (rows, "BS"[rows % 2])
            rows += 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 5 * peaks[0]


def test_events_may_be_a_folder(spark, tmp_path):
    from barline.streaming import live

    one = spark.range(500).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts", "id AS user_id", "'A' AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props")
    one.repartition(3).write.parquet(f"{tmp_path}/many/events.parquet")
    pq.write_table(one.toArrow(), (tmp_path / "events.parquet"))
    for folder in (f"{tmp_path}/many", str(tmp_path)):
        assert live.drain(live.bars(live.events(spark, folder)), "bars").count() >= 7
