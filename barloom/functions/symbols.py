"""Security-code conventions. `exchange_code` is `nnnnnn.SH|SZ|BJ`."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom import rules


def zero_fill(code: Column, width: int = 6) -> Column:
    """Left-pad with zeros; unlike lpad, longer text is kept whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def to_exchange_code(code: Column) -> Column:
    digits = zero_fill(F.trim(code.cast("string")))
    head = F.substring(digits, 1, 1)
    market = (
        F.when(head.isin(*rules.BJ_FIRST_DIGITS), "BJ")
        .when(head.isin(*rules.SH_FIRST_DIGITS), "SH")
        .otherwise("SZ")
    )
    return F.concat(digits, F.lit("."), market)


def number_part(code: Column) -> Column:
    return zero_fill(F.split_part(code, F.lit("."), F.lit(1)))


def market_part(code: Column) -> Column:
    return F.split_part(code, F.lit("."), F.lit(2))


def to_market_first(exchange_code: Column, sep: str = "") -> Column:
    """`600000.SH` -> `sh600000`, or `sh.600000` with a separator."""
    return F.concat(F.lower(market_part(exchange_code)), F.lit(sep), number_part(exchange_code))


def from_market_first(code: Column) -> Column:
    """`sh.600000` -> `600000.SH`."""
    return F.concat(
        zero_fill(F.split_part(code, F.lit("."), F.lit(2))),
        F.lit("."),
        F.upper(F.split_part(code, F.lit("."), F.lit(1))),
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def to_long_suffix(exchange_code: Column) -> Column:
    """`600000.SH` -> `600000.XSHG`; an unknown market is an error."""
    suffix = _lookup(rules.MARKET_SUFFIX, F.upper(market_part(exchange_code)))
    return F.concat(
        number_part(exchange_code), F.lit("."),
        F.coalesce(suffix, F.raise_error(F.concat(F.lit("unknown market in code "), exchange_code))),
    )


def try_from_long_suffix(code: Column) -> Column:
    """`600000.XSHG` -> `600000.SH`, null when the market is unknown."""
    text = F.trim(code)
    return F.concat(number_part(text), F.lit("."), _lookup(rules.SUFFIX_MARKET, F.upper(market_part(text))))


def from_long_suffix(code: Column) -> Column:
    return F.coalesce(
        try_from_long_suffix(code),
        F.raise_error(F.concat(F.lit("unknown market in code "), code)),
    )


def _share_prefix(number: Column, market: Column) -> Column:
    tests = [
        (market == m) & F.substring(number, 1, len(prefixes[0])).isin(*prefixes)
        for m, prefixes in rules.SHARE_PREFIXES.items()
    ]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return F.coalesce(hit, F.lit(False))


def is_share_long_suffix(code: Column) -> Column:
    """Shares only: index codes and unreadable codes are False."""
    parsed = try_from_long_suffix(code)
    return _share_prefix(number_part(parsed), market_part(parsed))


def is_share_market_first(code: Column) -> Column:
    lowered = F.split_part(code, F.lit("."), F.lit(1))
    number = zero_fill(F.split_part(code, F.lit("."), F.lit(2)))
    ok = _share_prefix(number, F.upper(lowered)) & (lowered == F.lower(lowered))
    return F.when(F.contains(code, F.lit(".")), ok).otherwise(False)


def board_of(exchange_code: Column) -> Column:
    market, number = market_part(exchange_code), F.split_part(exchange_code, F.lit("."), F.lit(1))
    board = (
        F.when(market == "SH", F.when(F.startswith(number, F.lit("688")), "star").otherwise("main"))
        .when(market == "SZ", F.when(F.startswith(number, F.lit("300")), "gem").otherwise("main"))
        .when(market == "BJ", "bse")
    )
    return F.coalesce(board, F.raise_error(F.concat(F.lit("no board for code "), exchange_code)))


def board_or_inferred(board: Column, exchange_code: Column) -> Column:
    return F.when(board.isin(*rules.BOARDS), board).otherwise(board_of(exchange_code))


def clean_vendor_code(code: Column) -> Column:
    """Prefixed vendor code -> six digits; null when no digit is left."""
    digits = F.regexp_replace(F.lower(code), "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.right(zero_fill(digits), F.lit(6)))


def code_on_named_exchange(number: Column, exchange_name: Column) -> Column:
    """Constituent row: exchange name (either language) -> suffix; without a name, by first digit."""
    number = zero_fill(F.trim(number.cast("string")))
    named = (
        F.when(exchange_name.contains("上海") | exchange_name.contains("Shanghai"), ".SH")
        .when(exchange_name.contains("北京") | exchange_name.contains("Beijing"), ".BJ")
        .otherwise(".SZ")
    )
    return F.when(exchange_name.isNull(), to_exchange_code(number)).otherwise(F.concat(number, named))


def industry_label(code: Column, name: Column) -> Column:
    code, name = F.trim(code), F.trim(F.coalesce(name, F.lit("")))
    full = F.when(code.rlike(r"^\d+$"), F.concat(code, F.lit(".SI"))).otherwise(code)
    return F.when(F.length(name) > 0, F.concat(full, F.lit("|"), name)).otherwise(full)


def industry_code(label: Column) -> Column:
    return F.trim(F.split_part(label, F.lit("|"), F.lit(1)))


def industry_name(label: Column) -> Column:
    """Text after the first bar; empty without one."""
    return F.when(label.contains("|"), F.trim(F.regexp_replace(label, r"^[^|]*\|", ""))).otherwise("")


def industry_display(label: Column) -> Column:
    return F.when(label.contains("|"), F.regexp_replace(label, r"^[^|]*\|", "")).otherwise(label)
