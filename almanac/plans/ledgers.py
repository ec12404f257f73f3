"""Ledger analytics: metrics, daily state, returns, comparisons and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import dates
from almanac.operators import joins, ledger as lg, spine as sp
from almanac.operators.lineage import written
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.selection import YEARLY_NET, yearly_net
from almanac.plans.sqlviews import twin

RATE = 0.00001
ORDER = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "amount"]
STATE = f"""ledger_daily AS (SELECT strategy, date, sum(amount) AS amount, sum(revenue) AS revenue, sum(transaction_cost) AS transaction_cost, max(price) AS price FROM trades GROUP BY 1, 2),
  ledger_days AS (SELECT strategy, CAST(unnest(generate_series((SELECT min(date) FROM ledger_daily), (SELECT max(date) FROM ledger_daily), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT strategy FROM ledger_daily)),
  held AS (SELECT d.strategy, d.date, coalesce(l.amount, 0) AS sold, last_value(l.price IGNORE NULLS) OVER w AS price, sum(coalesce(l.amount, 0)) OVER (PARTITION BY d.strategy) - sum(coalesce(l.amount, 0)) OVER w AS inventory,
    sum(coalesce(l.revenue, 0)) OVER w AS cumulative_revenue, sum(coalesce(l.transaction_cost, 0)) OVER w AS cumulative_cost FROM ledger_days d LEFT JOIN ledger_daily l ON l.strategy = d.strategy AND l.date = d.date
    WINDOW w AS (PARTITION BY d.strategy ORDER BY d.date ROWS UNBOUNDED PRECEDING)),
  state AS (SELECT *, coalesce(inventory * price * {RATE}::DOUBLE, 0) AS daily_storage_cost, sum(coalesce(inventory * price * {RATE}::DOUBLE, 0)) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_storage FROM held),
  valued AS (SELECT *, coalesce(inventory * price, 0) + cumulative_revenue - cumulative_cost - cumulative_storage AS net_value FROM state)"""


def daily_state(spark, sf):
    trades = t.trades(spark, sf)
    daily = written(trades.groupBy("strategy", "date").agg(*[F.sum(c).alias(c) for c in ("amount", "revenue", "transaction_cost")], F.max("price").alias("price")), "ledger")
    return lg.daily_state(daily, sp.data_spine(daily, ["strategy"]), ["strategy"], storage_rate=RATE)


@query("ledger_state", "L4 W20 L3", twin("trades", "SELECT strategy, date, sold, price, inventory, round(daily_storage_cost, 4) AS daily_storage_cost, round(net_value, 0) AS net_value FROM valued", STATE))
def ledger_state(spark, sf):
    made = lg.net_value(daily_state(spark, sf)).select("strategy", "date", "sold", "price", "inventory", "daily_storage_cost", "net_value")
    return rounded(rounded(made, ["daily_storage_cost"]), ["net_value"], 0)


METRICS = """coalesce(n_trades, 0) AS n_trades, coalesce(days, 0) AS days_to_liquidate, coalesce(n_days, 0) AS n_days, round(coalesce(rev, 0), 4) AS total_revenue, round(coalesce(tc, 0), 4) AS transaction_costs, round(coalesce(sc, 0), 3) AS storage_costs,
  round(coalesce(avg_price, 0), 4) AS avg_sale_price, coalesce(fp, 0) AS first_sale_price, coalesce(lp, 0) AS last_sale_price, round(coalesce(gap, 0), 6) AS avg_days_between_trades, round(coalesce(rev, 0) - coalesce(tc, 0) - coalesce(sc, 0), 3) AS net_earnings"""
SORTED = "(date, l_orderkey, l_linenumber, l_partkey, l_suppkey, price, amount)"


def _metrics_sql(period: str | None) -> str:
    p, k = (f", {period} AS period", "strategy, period") if period else ("", "strategy")
    return f"""SELECT {k}, {METRICS} FROM (SELECT strategy{p}, count(*) AS n_trades, CAST(date_diff('day', min(date), max(date)) AS BIGINT) AS days, sum(revenue) AS rev, sum(transaction_cost) AS tc, sum(revenue) / sum(amount) AS avg_price,
      arg_min(price, {SORTED}) AS fp, arg_max(price, {SORTED}) AS lp, date_diff('day', min(date), max(date)) / CAST(nullif(count(*) - 1, 0) AS DOUBLE) AS gap FROM trades GROUP BY ALL) a
      FULL JOIN (SELECT strategy{p}, sum(daily_storage_cost) AS sc, count(*) AS n_days FROM state GROUP BY ALL) b USING ({k})"""


def _metrics(spark, sf, period=None):
    made = lg.ledger_metrics(t.trades(spark, sf), daily_state(spark, sf), ["strategy"], ORDER, period)
    made = rounded(made, ["total_revenue", "transaction_costs", "avg_sale_price"])
    return rounded(rounded(made, ["storage_costs", "net_earnings"], 3), ["avg_days_between_trades"], 6)


@query("ledger_overall", "L1", twin("trades", _metrics_sql(None), STATE))
def ledger_overall(spark, sf):
    return _metrics(spark, sf)


@query("ledger_by_year", "L2", twin("trades", _metrics_sql("CAST(year(date) AS VARCHAR)"), STATE))
def ledger_by_year(spark, sf):
    return _metrics(spark, sf, dates.year_key("date"))


@query("ledger_by_quarter", "L2", twin("trades", _metrics_sql("year(date) || '-Q' || quarter(date)"), STATE))
def ledger_by_quarter(spark, sf):
    return _metrics(spark, sf, dates.quarter_key("date"))


@query("ledger_by_month", "L2", twin("trades", _metrics_sql("strftime(date, '%Y-%m')"), STATE))
def ledger_by_month(spark, sf):
    return _metrics(spark, sf, dates.month_key("date"))


MONTHLY = STATE + """, month_ends AS (SELECT strategy, strftime(date, '%Y-%m') AS month, arg_max(net_value, date) AS v FROM valued GROUP BY 1, 2),
  month_rets AS (SELECT strategy, month, v / nullif(lag(v) OVER (PARTITION BY strategy ORDER BY month), 0) - 1 AS ret FROM month_ends),
  excess AS (SELECT a.strategy, a.month, a.ret, b.ret AS baseline_ret, a.ret - b.ret AS excess FROM month_rets a JOIN month_rets b ON a.month = b.month AND b.strategy = 'N' WHERE a.strategy <> 'N' AND a.ret IS NOT NULL AND b.ret IS NOT NULL)"""


def monthly_excess(spark, sf):
    return lg.monthly_returns(lg.net_value(daily_state(spark, sf)), "strategy", "N")


@query("monthly_returns", "L5 A16", twin("trades", "SELECT strategy, month, round(ret, 8) AS ret, round(baseline_ret, 8) AS baseline_ret, round(excess, 8) AS excess FROM excess", MONTHLY))
def monthly_returns(spark, sf):
    return rounded(monthly_excess(spark, sf), ["ret", "baseline_ret", "excess"], 8)


DAILY_RETS = STATE + """, day_rets AS (SELECT strategy, date, net_value, net_value / nullif(lag(net_value) OVER (PARTITION BY strategy ORDER BY date), 0) - 1 AS ret FROM valued),
  grown AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)) AS c FROM day_rets),
  dropped AS (SELECT *, c / max(c) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM grown),
  folio AS (SELECT strategy, arg_min(net_value, date) AS v0, arg_max(net_value, date) AS v1, count(ret) AS n, stddev_pop(ret) * sqrt(252) AS vol, stddev_pop(ret) FILTER (WHERE ret < 0) * sqrt(252) AS dvol, min(dd) AS dd,
    avg(CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END) AS win FROM dropped GROUP BY 1)"""


@query("portfolio_metrics", "L6 W21", twin("trades", """SELECT strategy, round(100 * (v1 / v0 - 1), 6) AS total_return, round(100 * a, 6) AS annualized_return, round(100 * vol, 6) AS volatility, round((a - 0.02::DOUBLE) / vol, 5) AS sharpe,
  round(coalesce((a - 0.02::DOUBLE) / nullif(dvol, 0), 0), 5) AS sortino, round(a / abs(dd), 5) AS calmar, round(100 * dd, 6) AS max_drawdown, round(100 * win, 6) AS win_rate, n FROM (SELECT *, pow(v1 / v0, 252.0::DOUBLE / n) - 1 AS a FROM folio)""", DAILY_RETS))
def portfolio_metrics(spark, sf):
    made = lg.portfolio_metrics(lg.net_value(daily_state(spark, sf)), "strategy")
    return rounded(rounded(made, ["total_return", "annualized_return", "volatility", "max_drawdown", "win_rate"], 6), ["sharpe", "sortino", "calmar"], 5)


@query("efficiency_against_best", "L7 F11", twin("trades", """SELECT y.strategy, y.year, y.net, b.best, round(100 * y.net / b.best, 6) AS efficiency_pct, CASE WHEN 100 * y.net / b.best >= 80 THEN 'EXCELLENT' WHEN 100 * y.net / b.best >= 70 THEN 'GOOD'
  WHEN 100 * y.net / b.best >= 60 THEN 'FAIR' ELSE 'POOR' END AS grade FROM yearly y JOIN (SELECT year, max(net) AS best FROM yearly GROUP BY 1) b ON b.year = y.year""", YEARLY_NET))
def efficiency_against_best(spark, sf):
    results = yearly_net(spark, sf)
    best = results.groupBy("year").agg(F.max("net").alias("best"))
    return rounded(lg.efficiency(results, best, ["year"], "net", "best"), ["efficiency_pct"], 6)


COUNTER = """counter AS (SELECT tr.*, b.p * tr.amount * 0.995::DOUBLE AS immediate_net, tr.revenue - tr.transaction_cost - b.p * tr.amount * 0.995::DOUBLE AS difference FROM trades tr JOIN (SELECT year(date) AS y, avg(price) AS p FROM trades WHERE strategy = 'N' GROUP BY 1) b
  ON b.y = year(tr.date) WHERE tr.strategy <> 'N')"""


def counterfactual(spark, sf):
    rows = t.trades(spark, sf)
    return lg.immediate_sale_difference(rows.filter(F.col("strategy") != "N"), rows.filter(F.col("strategy") == "N"), fee_pct=0.5)


@query("immediate_sale_counterfactual", "L8", twin("trades", "SELECT strategy, date, l_orderkey, l_linenumber, amount, revenue, round(immediate_net, 3) AS immediate_net, round(difference, 3) AS difference FROM counter", COUNTER))
def immediate_sale_counterfactual(spark, sf):
    made = counterfactual(spark, sf).select("strategy", "date", "l_orderkey", "l_linenumber", "amount", "revenue", "immediate_net", "difference")
    return rounded(made, ["immediate_net", "difference"], 3)


IMPROVE = """SELECT strategy, round(avg(100 * (a.net - b) / abs(b)), 6) AS mean_improvement_pct, count(*) AS n_periods, false AS winner FROM {src} a JOIN (SELECT year, net AS b FROM {src} WHERE strategy = 'N') USING (year) WHERE strategy <> 'N'
  AND year IN (SELECT year FROM {src} GROUP BY 1 HAVING min(net) > 0) GROUP BY 1"""


@query("mean_improvement", "L22", twin("trades", f"SELECT strategy, mean_improvement_pct, n_periods, mean_improvement_pct = max(mean_improvement_pct) OVER () AS winner FROM ({IMPROVE.format(src='yearly')})", YEARLY_NET))
def mean_improvement(spark, sf):
    made = lg.mean_improvement(yearly_net(spark, sf), [], "strategy", "N", "net", "year")
    return rounded(made, ["mean_improvement_pct"], 6)


OVERLAP = YEARLY_NET + """, shared AS (SELECT * FROM yearly WHERE year IN (SELECT year FROM yearly GROUP BY 1 HAVING count(DISTINCT strategy) = (SELECT count(DISTINCT strategy) FROM yearly)))"""


@query("overlapping_comparison", "L23 T6", twin("trades", f"SELECT strategy, mean_improvement_pct, n_periods, mean_improvement_pct = max(mean_improvement_pct) OVER () AS winner FROM ({IMPROVE.format(src='shared')})", OVERLAP))
def overlapping_comparison(spark, sf):
    shared = lg.overlapping_results(yearly_net(spark, sf), "strategy", "year")
    return rounded(lg.mean_improvement(shared, [], "strategy", "N", "net", "year"), ["mean_improvement_pct"], 6)


@query("cost_sensitivity", "L25", twin("trades", "SELECT strategy, m AS multiplier, round(sum(revenue) - m * sum(transaction_cost), 2) AS net FROM trades, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE)) v(m) GROUP BY 1, 2"))
def cost_sensitivity(spark, sf):
    return rounded(lg.cost_sensitivity(t.trades(spark, sf), "strategy", [0.5, 1.0, 2.0, 5.0]), ["net"], 2)


@query("result_validation", "L21", twin("trades", """SELECT y.strategy, count(*) AS n_rows, count(*) FILTER (WHERE net IS NULL) AS n_null, count(*) - count(DISTINCT year) AS n_duplicates, (SELECT count(DISTINCT year) FROM yearly) - count(DISTINCT year) AS n_missing,
  min(net) AS low, max(net) AS high, CAST(count(*) FILTER (WHERE abs((net - m) / s) > 1.5) AS BIGINT) AS n_outliers FROM yearly y JOIN (SELECT strategy, avg(net) AS m, stddev_samp(net) AS s FROM yearly GROUP BY 1) k ON k.strategy = y.strategy GROUP BY 1""", YEARLY_NET))
def result_validation(spark, sf):
    return lg.validate_results(yearly_net(spark, sf), "strategy", "year", "net", sigmas=1.5)
