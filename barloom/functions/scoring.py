"""Scores, stance and tags of a security card."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from barloom import rules


def dimension_score(percentile: Column, inverted: bool) -> Column:
    return 100.0 * ((1.0 - percentile) if inverted else percentile)


def mean_present(columns: list[Column]) -> Column:
    """Mean over the non-null columns, null when all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in columns])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(total, present)


def stance(composite: Column, strength: Column, status: Column) -> Column:
    tilt = F.greatest(F.least(F.coalesce(strength, F.lit(0.0)) * 100.0, F.lit(10.0)), F.lit(-10.0))
    x = F.coalesce(composite, F.lit(50.0)) + tilt
    return (
        F.when(F.coalesce(status == "blocked", F.lit(False)), rules.STANCE["weak"])
        .when(composite.isNull() & strength.isNull(), rules.STANCE["unknown"])
        .when(x >= rules.STANCE_STRONG, rules.STANCE["strong"])
        .when(x <= rules.STANCE_WEAK, rules.STANCE["weak"])
        .otherwise(rules.STANCE["neutral"])
    )


def tag_list(tests: list[tuple[Column, str]]) -> Column:
    """Tags whose test holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(t, F.lit(rules.TAGS[name])) for t, name in tests])))


def card_tags(c: dict[str, Column]) -> Column:
    """Threshold tags; `c` maps the short names below to columns of the card."""
    factors_missing = reduce(
        lambda a, b: a | b, [c[f].isNull() for f, _ in rules.DIMENSIONS.values()]
    )
    own = tag_list([
        (c["is_suspended"] == 1, "suspended"),
        (c["is_st"] == 1, "st"),
        (c["at_up"], "limit_up"),
        (c["at_down"], "limit_down"),
        (c["momentum"] >= rules.SCORE_HIGH, "momentum_strong"),
        (c["momentum"] <= rules.SCORE_LOW, "momentum_weak"),
        (c["volatility"] <= rules.SCORE_LOW, "volatile"),
        (c["valuation"] <= rules.SCORE_LOW, "expensive"),
        (c["valuation"] >= rules.SCORE_HIGH, "cheap"),
        (c["turnover"] <= rules.SCORE_LOW, "crowded"),
        (c["strength"] >= rules.STRENGTH_GAP, "beats_benchmark"),
        (c["strength"] <= -rules.STRENGTH_GAP, "trails_benchmark"),
        (factors_missing, "factors_missing"),
        (c["finance_stale"], "finance_stale"),
    ])
    peer = tag_list([
        (c["mom_20_in_industry"] >= rules.PEER_TOP, "industry_momentum_top"),
        (c["mom_20_in_industry"] <= rules.PEER_BOTTOM, "industry_momentum_bottom"),
        ((c["ep_in_industry"] >= rules.PEER_TOP) | (c["bp_in_industry"] >= rules.PEER_TOP), "industry_value_top"),
        (c["status"] == "blocked", "not_tradable"),
        (c["status"] == "caution", "trade_with_care"),
    ])
    return F.array_union(own, peer)


def lag_bucket(days: Column, ok_within: int, lag_within: int) -> Column:
    return (
        F.when(days.isNull(), "missing")
        .when(days <= ok_within, "ok")
        .when(days <= lag_within, "lag")
        .otherwise("stale")
    )
