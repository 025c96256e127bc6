"""Scalar functions of the market-data model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.schema import is_finite

PRICE_SCALE = 100_000_000
#: Largest price with a key; above it the key does not fit into an unsigned 64-bit integer.
MAX_PRICE = float(2**64) / PRICE_SCALE
#: A remainder of no more than this share of the original quantity is dust.
DUST = 1e-9
SYMBOL_BYTES = 23
CANDLE_BYTES = 48
MIN_RING, MAX_RING = 256, 1_000_000
FALLBACK_L3 = 8 << 20


def price_key(price: Column) -> Column:
    """Price in units of 1e-8, rounded half away from zero. Prices above 9.22e10 do not fit into a LONG and raise."""
    return F.round(price * PRICE_SCALE).cast("long")


def wide_price_key(price: Column) -> Column:
    """The same as DECIMAL(20, 0), for every price that has a key."""
    return F.round((price * PRICE_SCALE).cast("decimal(38,4)")).cast("decimal(20,0)")


def key_price(key: Column) -> Column:
    return key.cast("double") / float(PRICE_SCALE)


def qty_is_zero(remaining: Column, original: Column) -> Column:
    return remaining <= original * DUST


def signed_qty(side: Column, qty: Column) -> Column:
    return F.when(side == "B", qty).otherwise(-qty)


def unrealized_pnl(position: Column, cost: Column, mark: Column) -> Column:
    return (mark - cost) * position


def limit_fill_price(side: Column, price: Column, open_: Column, high: Column, low: Column) -> Column:
    """What a limit order gets from a candle that reaches it: its price or a better open. Null if not reached or without price."""
    return F.when((side == "B") & (low <= price), F.least(price, open_)).when((side == "S") & (high >= price), F.greatest(price, open_))


def order_fault(qty: Column, price: Column) -> Column:
    """The first reason to refuse an order, null for a good one. An order without a price is judged by its quantity."""
    return (
        F.when(~is_finite(qty) | (qty <= 0), "QuantityInvalid")
        .when(price.isNotNull() & ~is_finite(price), "PriceNotFinite")
        .when(price <= 0, "PriceNotPositive")
        .when(price > MAX_PRICE, "PriceOutOfRange")
    )


def signal_fault(symbol: Column, qty: Column, price: Column) -> Column:
    """The first reason to refuse a signal, null for a good one. Zero and negative quantities pass here."""
    return (
        F.when(F.octet_length(symbol) > SYMBOL_BYTES, "SymbolTooLong")
        .when(~is_finite(qty), "QtyNotFinite")
        .when(~is_finite(price), "PriceNotFinite")
    )


def lossy_symbol(symbol: Column) -> Column:
    """The first 23 bytes of a symbol; empty if the cut falls inside a character."""
    cut = F.substring(F.encode(symbol, "UTF-8"), 1, SYMBOL_BYTES)
    return F.coalesce(F.try_validate_utf8(cut.cast("string")), F.lit(""))


def decode_symbol(field: Column) -> Column:
    """A fixed-width symbol up to its first NUL."""
    return F.substring_index(field, "\0", 1)


def decode_side(code: Column) -> Column:
    """0 is Buy, anything else Sell."""
    return F.when(code == 0, "B").otherwise("S")


def store_key(symbol: Column, interval: Column) -> Column:
    return F.concat(F.upper(symbol), F.lit(":"), interval)


def stream_name(symbol: Column, interval: Column) -> Column:
    return F.concat(F.lower(symbol), F.lit("@kline_"), interval)


def escape_symbol(symbol: Column) -> Column:
    """Letters, digits and hyphens stay, other signs become an underscore. Not injective: do not use it as a key."""
    return F.regexp_replace(symbol, "[^\\p{L}\\p{N}-]", "_")


def load_position(written: Column) -> Column:
    """A position as read from a file's text: 0 if it is missing, no number or not finite."""
    value = written.try_cast("double")
    return F.when(is_finite(value), value).otherwise(0.0)


def parse_cache_size(text: Column) -> Column:
    """Bytes of a size like 32K, 8M or 512; null if it is none."""
    number = F.trim(F.regexp_extract(text, "^(.*?)[KM]?$", 1)).try_cast("long")
    return number * F.when(text.endswith("K"), 1 << 10).when(text.endswith("M"), 1 << 20).otherwise(1)


def resource_fraction(fraction: Column) -> Column:
    return F.least(F.greatest(fraction, F.lit(0.05)), F.lit(1.0))


def usable_cores(cores: Column, fraction: Column) -> Column:
    return F.greatest(F.ceil(cores * resource_fraction(fraction)).cast("long"), F.lit(1).cast("long"))


def ring_capacity(l3_bytes: Column, fraction: Column, symbols: Column) -> Column:
    """Candles of one symbol such that all symbols fit into the usable part of a cache, between 256 and a million."""
    usable = F.floor(l3_bytes * resource_fraction(fraction)).cast("long")
    each = F.floor(F.floor(usable / F.greatest(symbols, F.lit(1))) / CANDLE_BYTES).cast("long")
    return F.least(F.greatest(each, F.lit(MIN_RING).cast("long")), F.lit(MAX_RING).cast("long"))


def candles_per_line(line_bytes: Column) -> Column:
    return F.greatest(F.floor(line_bytes / CANDLE_BYTES).cast("long"), F.lit(1).cast("long"))
