"""What jobs shuffle and keep: no more columns and rows than they need, with the same results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import asof, judgment as jd
from barloom.session import bucketed
from suite import QUERIES
from tests.test_stored_bars import sf  # noqa: F401

D = dt.date(2000, 1, 1)


def _day(n):
    return None if n is None else D + dt.timedelta(days=n)


@pytest.fixture
def facts(spark):
    """Two factors on ten days of four securities and of none."""
    return spark.createDataFrame(
        [(_day(d), s, f, 1.0 * (d * 7 + (s or 0) * 3) % 5) for s in (1, 2, 3, 4, None) for d in range(10) for f in ("a", "b")] + [(None, 1, "a", 1.0)],
        "trade_date date, security_id int, factor_name string, value double",
    )


@pytest.fixture
def spans(spark):
    """Apart, touching, hidden by a later start, open at the start, without an end, before all days."""
    return spark.createDataFrame(
        [(s, "L", x, _day(a), _day(b)) for s, x, a, b in (
            (1, "p", 0, 3), (1, "q", 3, 5), (1, "r", 7, 99), (2, "p", 0, 99), (2, "q", 4, 6), (3, "p", None, 4), (3, "q", 6, None), (9, "p", 0, 99),
            (4, "p", -9, -5),
        )], "security_id int, level string, industry string, in_date date, out_date date",
    )


def _exchanges(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_attach_in_place_is_attach_interval(facts, spans, rows):
    args = (spans, ["security_id"], ["industry"])
    got = rows(asof.attach_in_place(facts, *args), "security_id", "trade_date", "factor_name", "industry")
    assert got == rows(asof.attach_interval(facts, *args), "security_id", "trade_date", "factor_name", "industry")
    assert any(r[3] for r in got) and len(got) == facts.count()


def test_bucketed_facts_are_not_shuffled(facts, spans, rows):
    kept = bucketed(facts, "facts", "security_id", ["factor_name"])
    assert rows(kept) == rows(facts)
    out = asof.attach_in_place(kept, spans, ["security_id"], ["industry"])
    assert not any("factor_name" in x or "value" in x for x in _exchanges(out))
    assert all("trade_date" not in x for x in _exchanges(out))


@pytest.mark.parametrize("kind", ["industry", "index"])
def test_percentiles_move_bucketed_factors_once(spark, facts, spans, rows, kind):
    """One shuffle by day and factor; the security's intervals come to the factors."""
    def ranked(table):
        if kind == "industry":
            return jd.industry_percentiles(table, spans, "L")
        return jd.index_percentiles(table, spans.withColumn("index_code", F.lit("I")), "I")

    out = ranked(bucketed(facts, "facts", "security_id", ["factor_name"]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan  # facts and intervals as one stream would be shuffled by security
    assert rows(out, "security_id", "trade_date", "factor_name", "pct", "n") == rows(ranked(facts), "security_id", "trade_date", "factor_name", "pct", "n")


@pytest.mark.parametrize("name", ["W13_industry_percentile", "W13_index_percentile"])
def test_percentiles_keep_three_columns_of_the_bars(spark, sf, name, monkeypatch):  # noqa: F811
    kept = _written(monkeypatch)
    QUERIES[name].run(spark, sf).collect()
    assert kept["bars"] == ["security_id", "trade_date", "close", "volume", "adj_factor"]


def test_refresh_leaves_bucketed_rows_where_they_are(spark, rows):
    """Rows to keep are told by a join on the security alone; rows without one, or of another version or factor, follow their own ranges."""
    from barloom.operators import refresh

    bars = [(s, D + dt.timedelta(days=d), 10.0 + d % 3, 1.0, 100.0, 0.5 + d % 4) for s in (1, 2, None) for d in range(40)]
    def inputs(bent):
        table = spark.createDataFrame([(s, d, c * (2 if (s, d.day) in bent else 1), a, mv, t + ((s, d.day) in bent)) for s, d, c, a, mv, t in bars],
                                      "security_id int, trade_date date, close double, adj_factor double, total_mv double, turnover_rate double")
        none = spark.createDataFrame([], "security_id int, ann_date date, report_date date, stmt_type string, update_flag int, fields map<string,double>")
        return refresh.Inputs(table.select("security_id", "trade_date", "close", "adj_factor"), table.select("security_id", "trade_date", "total_mv", "turnover_rate"), none)

    before, after = inputs(set()), inputs({(1, 25), (None, 30)})
    names = ["mom_20", "turn_20"]
    odd = [(_day(30), 1, "mom_20", "v0", 1.0), (None, 1, "mom_20", "v1", 2.0), (_day(30), 1, "mine", "v1", 3.0), (_day(30), 1, "mom_20", None, 4.0)]
    from barloom.operators import factors as fct

    odd = spark.createDataFrame(odd, "trade_date date, security_id int, factor_name string, version string, value double")
    stored = bucketed(fct.compute(*before, names=names).unionByName(odd), "factors", "security_id", ["factor_name"])
    got = refresh.refresh(stored, before, after, names=names)
    assert rows(got.table) == rows(fct.compute(*after, names=names).unionByName(odd))
    kept = [x for x in _exchanges(refresh._kept(stored, [(names, got.ranges.drop("factor_name"))], "v1")) if "factor_name" in x]
    assert all("isnull" in x for x in kept)  # only the branch of rows without a security


def test_refresh_compares_the_ratios_once(spark, sf, monkeypatch):  # noqa: F811
    from barloom.operators import publish as pb

    seen, reconcile = [], pb.reconcile
    monkeypatch.setattr(pb, "reconcile", lambda a, b: (seen.append(a.columns), reconcile(a, b))[1])
    QUERIES["C10_refreshed_factors"].run(spark, sf).collect()
    assert [c[2:] for c in seen[:2]] == [["turnover_rate", "total_mv"], ["close", "adj_factor"]] and len(seen) == 3


def test_execution_leaves_bucketed_bars_where_they_are(spark, sf):  # noqa: F811
    from barloom.sources.market import Market

    m = Market(spark, sf).stored(columns=("open", "close", "volume", "pre_close", "adj_factor", "is_suspended"))
    assert not any("open" in x or "trade_date" in x for x in _exchanges(m.execution))


def test_experiment_attaches_industries_to_the_chosen_only(spark, sf, monkeypatch, rows):  # noqa: F811
    from barloom.operators import weights as wt
    from barloom.plans import research as rs
    from barloom.sources.market import Market

    m, spec, seen, attach = Market(spark, sf), rs.Spec(methods=("industry_neutral",), top_n=1, filters=()), [], asof.attach_interval
    monkeypatch.setattr(asof, "attach_interval", lambda df, *a, **k: (seen.append(df), attach(df, *a, **k))[1])
    args = (m.limited_bars, m.factors("mom_20"), m.master, spec)
    whole, chosen = rs.panel(*args, industry=m.industries), rs.panel(*args, industry=m.industries, selected=True)
    assert rows(chosen) == rows(wt.select_names(whole, ["factor_name", "trade_date"], 1)) and seen[-1].count() < seen[-2].count()
    assert rows(rs.weight_series(chosen, spec)) == rows(rs.weight_series(whole, spec))


def test_series_is_the_same_by_shuffles(spark, sf, monkeypatch, rows):  # noqa: F811
    """Few positions are sent to the bars; many are joined by a shuffle."""
    from barloom.operators import performance as pf

    from barloom.operators import prices as pr
    from barloom.plans import research as rs
    from barloom.sources.market import Market

    m, spec = Market(spark, sf), rs.Spec(top_n=1, filters=())
    weights = rs.weight_series(rs.panel(m.limited_bars, m.factors("mom_20"), m.master, spec), spec)
    args = (weights, pr.daily_returns(m.bars), m.execution, m.calendar)
    few = rows(pf.portfolio_series(*args, by=["factor_name", "weight_method"]))
    monkeypatch.setattr(pf, "FEW", 0)
    assert few and few == rows(pf.portfolio_series(*args, by=["factor_name", "weight_method"]))


def _written(monkeypatch) -> dict:
    from barloom.sources import market

    kept, write = {}, market.bucketed
    monkeypatch.setattr(market, "bucketed", lambda df, name, *a: (kept.update({name: df.columns}), write(df, name, *a))[1])
    return kept
