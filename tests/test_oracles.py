"""Every query with SQL against that SQL, over whole tables."""

import glob
import os

import compare
import duckdb
import pytest

from barline.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    assert compare.differences(spark, db, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_risk_gate_tells_every_signal(spark):
    assert registry.queries()["risk_gate"](spark, SF).count() == 10000


def test_files_pass_the_gate(spark):
    assert [tuple(r) for r in registry.queries()["cold_file_gate"](spark, SF).collect()] == [(None, True)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["symbol", "n", "seq", "ts", "side", "short_sma", "long_sma"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sql_views_and_functions(spark):
    from barline.plans import views

    views.register(spark, SF)
    assert spark.sql("SELECT count(*) FROM bars WHERE symbol = 'click' AND low <= high").first()[0] > 0
    row = spark.sql("SELECT price_key(1.5D), key_price(150000000), store_key('btc', '1m'), signed_qty('S', 2D), unrealized_pnl(-1D, 100D, 90D)").first()
    assert tuple(row) == (150_000_000, 1.5, "BTC:1m", -2.0, 10.0)


def small_events(folder, rows: str) -> duckdb.DuckDBPyConnection:
    """Writes an events table of the given SELECT, and has it as the view that the SQL reads."""
    db = duckdb.connect()
    db.sql(f"COPY ({rows}) TO '{folder}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return db


@pytest.mark.parametrize("name", ["paper_fills", "portfolio_cash_trades", "portfolio_pnl", "portfolio_positions"])
def test_free_orders_are_filled_as_in_sql(spark, tmp_path, name):
    """Some values are 0, as in the larger tables, and so are the prices of their orders."""
    db = small_events(tmp_path, "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 20) MINUTE AS ts, i // 3 AS user_id, 'A' AS event_type, CASE WHEN i % 5 = 0 THEN 0.0 ELSE i * 7 % 11 END::DOUBLE AS value, '' AS props FROM range(60) t(i)")
    assert compare.differences(spark, db, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) == ""


@pytest.mark.parametrize("name", ["ohlcv_resample", "stream_bars", "series_summary", "portfolio_cash_trades", "portfolio_pnl", "portfolio_positions"])
def test_missing_values_and_negative_numbers_as_in_sql(spark, tmp_path, name):
    """Some events have no value, among them the first and last of an hour and the last of all; numbers start below 0."""
    db = small_events(tmp_path, "SELECT i - 30 AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 20) MINUTE AS ts, i // 3 AS user_id, 'A' AS event_type, CASE WHEN i % 4 <> 3 THEN i * 7 % 11 + 1 END::DOUBLE AS value, '' AS props FROM range(60) t(i)")
    assert compare.differences(spark, db, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path)) == ""


def test_stream_crossover_counts_late_ticks(spark, tmp_path):
    """The second half has the times of the first again, as in tables that are made larger by copies."""
    db = small_events(tmp_path, "SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i % 60) MINUTE AS ts, i // 3 AS user_id, 'A' AS event_type, (i * i % 11)::DOUBLE AS value, '' AS props FROM range(120) t(i)")
    assert compare.differences(spark, db, registry.queries()["stream_crossover"], registry.oracle_sql()["stream_crossover"], str(tmp_path)) == ""


def test_cold_range_needs_no_folder_for_each_symbol(spark, tmp_path):
    db = small_events(tmp_path, "SELECT i AS event_id, TIMESTAMP '2024-01-07' + INTERVAL (i) SECOND AS ts, i * 7 % 300 AS user_id, 'A' AS event_type, (i % 11)::DOUBLE AS value, '' AS props FROM range(3000) t(i)")
    written = f"{spark.sparkContext.getConf().get('spark.checkpoint.dir').removeprefix('file://')}/cold-*/**/*.parquet"
    before = set(glob.glob(written, recursive=True))
    assert compare.differences(spark, db, registry.queries()["cold_range"], registry.oracle_sql()["cold_range"], str(tmp_path)) == ""
    assert 0 < len(set(glob.glob(written, recursive=True)) - before) < 30
