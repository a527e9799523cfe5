"""Cached payloads: JSON objects with an array of candles, read, trimmed, marked, filtered and judged as nested columns, without exploding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlight.operators import relational as R

CANDLE = "struct<time:bigint,open:double,high:double,low:double,close:double,volume:double,is_closed:boolean>"
PAYLOAD = f"symbol string, price double, candles array<{CANDLE}>, candles_provider string, session_policy string, next_refresh_at bigint, candle_alignment_version int"
#: Session policies, and how much more is fetched where bars out of session will be dropped.
REGULAR, DEFAULT, MULTIPLIER = "tradingview_regular", "provider_default", 2.5


def parsed(text: Column) -> Column:
    """The payload, null if the text is no JSON object; candles without a time are dropped, and an absent array is an empty one."""
    p = F.from_json(text, f"{PAYLOAD}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    candles = F.coalesce(F.filter(p["candles"], lambda c: c["time"].isNotNull()), F.array().cast(f"array<{CANDLE}>"))
    return F.when(p.isNotNull() & p["_broken"].isNull() & F.startswith(F.ltrim(text), F.lit("{")), p.dropFields("_broken").withField("candles", candles))


def recent(payload: Column, n: int) -> Column:
    """The payload with its last n candles; if some go, its price is the last close."""
    candles = payload["candles"]
    few = F.slice(candles, F.greatest(F.size(candles) - n, F.lit(0)) + 1, n)
    cut = payload.withField("candles", few).withField("price", F.coalesce(F.try_element_at(few, F.lit(-1))["close"], payload["price"]))
    return F.when(F.size(candles) > n, cut).otherwise(payload)


def marked(payload: Column, closes: Column, now: Column) -> Column:
    """The payload with its last candle marked: forming before its bar closes, with the mark taken off after. closes: when the bar of the
    last candle closes, in seconds."""
    candles = payload["candles"]
    last = F.try_element_at(candles, F.lit(-1))
    changed = last.withField("is_closed", F.when(now < closes, F.lit(False)).when(last["is_closed"].eqNullSafe(F.lit(False)), F.lit(None)).otherwise(last["is_closed"]))
    return F.when(F.size(candles) > 0, payload.withField("candles", F.concat(F.slice(candles, 1, F.size(candles) - 1), F.array(changed)))).otherwise(payload)


def in_session_only(payload: Column, n: int) -> Column:
    """The payload with the last n of its candles that open in the regular session."""
    return recent(payload.withField("candles", F.filter(payload["candles"], lambda c: R.in_session(c["time"]))), n)


def expected_policy(symbol: Column, seconds: int, policy: str = REGULAR) -> Column:
    """The session policy that a payload must have: one for bars of stocks that are shorter than a day, none otherwise."""
    return F.when(~symbol.endswith("-USD") & F.lit(seconds < 86400), F.lit(policy))


def session_compatible(payload: Column, symbol: Column, seconds: int, policy: str = REGULAR) -> Column:
    want = expected_policy(symbol, seconds, policy)
    return want.isNull() | F.coalesce(F.coalesce(payload["session_policy"], F.lit(DEFAULT)) == want, F.lit(False)) & payload.isNotNull()


def fetch_multiplier(symbol: Column, seconds: int, policy: str = REGULAR) -> Column:
    return F.when(F.coalesce(expected_policy(symbol, seconds, policy) == REGULAR, F.lit(False)), MULTIPLIER).otherwise(1.0)


def within_history(payload: Column, completed: Column) -> Column:
    """Whether the last daily candle's date on the exchange's clock is one of completed sessions (a date), and there is one."""
    last = F.try_element_at(payload["candles"], F.lit(-1))["time"]
    return F.coalesce(F.to_date(R.local(last)) <= completed, F.lit(False))


def anchored(payload: Column, minutes: int) -> Column:
    """Whether every candle begins a bucket that is counted from the session's open."""
    return F.forall(payload["candles"], lambda c: R.session_bucket(c["time"], minutes) == c["time"])
