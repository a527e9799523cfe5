"""Scalars on symbols, tokens, labels, timeframes and dates, as columns; a null counts as empty unless a function says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from barlight.operators.relational import normal_crypto

# Groups of exchanges by code, labels of categories, and what timeframes providers know.
EXCHANGE_GROUPS = {"XNAS": "nasdaq", "NASDAQ": "nasdaq", "XNYS": "nyse", "NYSE": "nyse", "XASE": "amex", "AMEX": "amex"}
CATEGORY_LABELS = {"sp500": "S&P 500", "dow_jones": "Dow Jones", "russell_2000": "Russell 2000"}
PROVIDER_UNITS = {"m": [1, 3, 5, 15, 30], "h": [1, 2, 4, 6, 8, 12], "d": [1, 3], "w": [1], "mo": [1]}
UNITS = {"m": ["min", "mins", "minute", "minutes"], "h": ["h", "hr", "hour", "hours"], "d": ["d", "day", "days"], "w": ["w", "wk", "week", "weeks"], "mo": ["mo", "mon", "month", "months"]}
SECONDS = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "mo": 30 * 86400}


def _said(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def symbol(x: Column) -> Column:
    return F.upper(_said(x))


def token(x: Column) -> Column:
    """Lower case with low lines for spaces and hyphens."""
    return F.translate(F.lower(_said(x)), " -", "__")


def exchange(x: Column) -> Column:
    return F.lower(_said(x))


def distinct_values(x: Column) -> Column:
    """The sorted set of an array's values in lower case; empty ones go."""
    clean = F.transform(F.coalesce(x, F.array().cast("array<string>")), exchange)
    return F.array_sort(F.array_distinct(F.filter(clean, lambda v: v != "")))


def availability(many: Column, one: Column) -> Column:
    """The exchanges of an item: of its list, or without one its only exchange."""
    single = exchange(one)
    return F.when(many.isNotNull(), distinct_values(many)).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))


def exchange_group(x: Column) -> Column:
    """nasdaq, nyse or amex of an exchange's code; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in EXCHANGE_GROUPS.items() for v in kv]), symbol(x))


def humanized(x: Column) -> Column:
    return F.initcap(F.trim(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("_"), F.lit(" "))))


def category_label(x: Column) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(v) for kv in CATEGORY_LABELS.items() for v in kv]), token(x))
    return F.coalesce(known, humanized(x))


def is_crypto(x: Column) -> Column:
    return F.coalesce(x.endswith("-USD"), F.lit(False))


def provider_crypto(x: Column) -> Column:
    """X:BASEUSD of any way to write a coin's pair with USD; empty where no base is left."""
    pair = normal_crypto(x)
    return F.when(pair == "", "").otherwise(F.concat(F.lit("X:"), F.regexp_replace(pair, "-USD$", ""), F.lit("USD")))


def stock_provider_symbol(x: Column) -> Column:
    base = F.upper(F.trim(F.replace(F.regexp_replace(x, "-USD$", ""), F.lit("-"), F.lit(""))))
    return F.when(is_crypto(x), F.concat(F.lit("X:"), base, F.lit("USD"))).otherwise(symbol(x))


def coin_base(x: Column) -> Column:
    return F.replace(F.regexp_replace(symbol(x), "-USDT?$", ""), F.lit("-"), F.lit(""))


def coin_provider_symbol(x: Column) -> Column:
    """BASEUSDT of a pair with USD; other pairs without hyphens."""
    s = symbol(x)
    return F.when(s.endswith("-USD"), F.concat(coin_base(x), F.lit("USDT"))).otherwise(F.replace(s, F.lit("-"), F.lit("")))


def provider(x: Column) -> Column:
    return F.when(is_crypto(x), "crypto").otherwise("stocks")


def decimal(x: Column, digits: int = 2, signed: bool = False) -> Column:
    """A fixed number of decimals, rounded half up; no number counts as 0."""
    v = F.coalesce(x.try_cast("double"), F.lit(0.0))
    n = F.floor(F.abs(v) * 10**digits + 0.5).cast("long")
    text = F.floor(n / 10**digits).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % 10**digits).cast("string"), digits, "0"))
    return F.concat(F.when(v < 0, "-").otherwise("+" if signed else ""), text)


def price(x: Column) -> Column:
    """$ and two, four or six decimals, with commas at thousands."""
    v = F.coalesce(x.try_cast("double"), F.lit(0.0))
    a = F.abs(v)
    out = F.when(a >= 1, F.format_number(a, 2)).when(a >= 0.01, F.format_number(a, 4)).otherwise(F.format_number(a, 6))
    return F.concat(F.lit("$"), F.when(v < 0, "-").otherwise(""), out)


def window_label(n: Column) -> Column:
    k = F.greatest(F.lit(1), F.coalesce(n.cast("long"), F.lit(1)))
    return F.concat(F.lit("Last "), k, F.when(k == 1, " Candle").otherwise(" Candles"))


def pattern_label(confirmation: Column, types: Column, patterns: Column) -> Column:
    first = lambda x: F.try_element_at(x, F.lit(1))
    return F.when(F.coalesce(confirmation, F.lit(False)), F.coalesce(humanized(F.coalesce(first(patterns), first(types))), F.lit("No Pattern"))).otherwise("No Pattern")


def sticker(name: Column, length: Column, decision: Column, condition: Column, pattern: Column, window: Column) -> Column:
    """The parts that are there, joined by bars."""
    title = F.when(length.isNotNull(), F.concat(name, F.lit(" ("), length.cast("string"), F.lit(")"))).otherwise(name)
    empty = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(" | ", title, empty(decision), empty(condition), empty(pattern), window_label(window))


def timeframe(text: str) -> tuple[int, str] | None:
    """Amount and unit (m, h, d, w, mo) of a timeframe; None of what is none. A single m is minutes, a single M months."""
    found = re.fullmatch(r"(\d+)\s*([A-Za-z]+)", (text or "").strip())
    if not found or int(found[1]) < 1:
        return None
    unit = {"m": "m", "M": "mo"}.get(found[2]) or next((u for u, names in UNITS.items() if found[2].lower() in names), None)
    return (int(found[1]), unit) if unit else None


def canonical_timeframe(text: str) -> str:
    """One spelling of each timeframe; an error of what is none."""
    found = timeframe(text)
    if not found:
        raise ValueError(f"unsupported timeframe: {text!r}")
    n, unit = found
    return f"{n}day" if unit == "d" else f"{n}{unit}"


def timeframe_seconds(text: str) -> int:
    n, unit = timeframe(canonical_timeframe(text))
    return n * SECONDS[unit]


def provider_timeframe(text: str) -> str | None:
    """What a provider of coins calls a timeframe; None of those it has not."""
    found = timeframe(text)
    if not found or found[0] not in PROVIDER_UNITS[found[1]]:
        return None
    return f"{found[0]}{'M' if found[1] == 'mo' else found[1]}"


def source_bars(text: str, limit: int, crypto: bool = False) -> int:
    """Daily bars that so many bars of a timeframe are made of."""
    n, unit = timeframe(canonical_timeframe(text))
    per = {"d": n, "w": n * (7 if crypto else 5), "mo": n * (30 if crypto else 21)}.get(unit, 1)
    return limit * max(1, per)


def previous_weekday(day: Column) -> Column:
    """The day itself, or the Friday before of a day on a weekend."""
    k = F.weekday(day)
    return F.date_sub(day, F.greatest(k - 4, F.lit(0)))


def last_session(seconds: Column, zone: str = "America/New_York", close: int = 16) -> Column:
    """The date of the last session that is over at a time: today after the close on a weekday, else the weekday before."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    today = F.to_date(local)
    over = (F.weekday(today) < 5) & (F.hour(local) >= close)
    return F.when(over, today).otherwise(previous_weekday(F.date_sub(today, 1)))


def weekdays_back(day: Column, n: int) -> Column:
    """The last n weekdays up to a day, newest first: those of the days that are sure to hold them."""
    days = F.transform(F.sequence(F.lit(0), F.lit(n * 7 // 5 + 9)), lambda k: F.date_sub(day, k))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def in_hours(seconds: Column, hours: str, offset: int = 0) -> Column:
    """Whether a time of day (UTC plus offset minutes) lies in HHMM-HHMM, which may run past midnight; all day if the text is none."""
    found = re.match(r"(\d\d)(\d\d)-(\d\d)(\d\d)(:|$)", hours or "")
    if not found or any(int(found[k]) > top for k, top in ((1, 23), (2, 59), (3, 23), (4, 59))):
        return F.lit(True)
    a, b = int(found[1]) * 60 + int(found[2]), int(found[3]) * 60 + int(found[4])
    now = F.pmod(F.floor(seconds / 60) + offset, F.lit(1440))
    return F.lit(True) if a == b else (now >= a) & (now < b) if a < b else (now >= a) | (now < b)


def canonical_utc(text: Column) -> Column:
    """ISO form in UTC of a timestamp with or without a zone, or of a date; null of what is none."""
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace(_said(text), "Z$", "+00:00")), F.to_timestamp(F.lit(None)))
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def either(config: dict, groups: dict[str, tuple[str, ...]], defaults: dict) -> dict:
    """Settings under their own names, from any of their aliases; two aliases that disagree are an error."""
    out = dict(defaults)
    for name, aliases in groups.items():
        said = {a: config[a] for a in aliases if config.get(a) is not None}
        if len(set(map(str, said.values()))) > 1:
            raise ValueError(f"conflicting settings for {name}: {said}")
        if said:
            out[name] = next(iter(said.values()))
    return out


def content_id(x: Column) -> Column:
    """24 hex digits of the SHA-256 of a struct's JSON with its fields as given."""
    return F.substring(F.sha2(F.to_json(x), 256), 1, 24)


def merged_json(old: Column, new: Column) -> Column:
    """A shallow merge of two JSON objects of strings: what new has wins."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, b)))))
