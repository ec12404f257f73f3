"""Tests of difference, resampling and corrections over ledger results."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import dates
from almanac.functions.picks import mixed_sql, pick_sql
from almanac.operators import hypothesis_tests as ht, joins, ledger as lg, resample as rs
from almanac.plans import tables as t
from almanac.plans.ledgers import COUNTER, DAILY_RETS, MONTHLY, counterfactual, daily_state, monthly_excess
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin

MONTH_NET = """months AS (SELECT strategy, strftime(date, '%Y-%m') AS month, year(date) AS year, sum(revenue - transaction_cost) AS net FROM trades GROUP BY 1, 2, 3),
  diffs AS (SELECT a.strategy, a.month, a.year, round(a.net - b.net, 4) AS difference FROM months a JOIN months b ON a.month = b.month AND b.strategy = 'N' WHERE a.strategy <> 'N')"""


def month_net(spark, sf):
    net = F.sum(F.col("revenue") - F.col("transaction_cost"))
    return t.trades(spark, sf).groupBy("strategy", dates.month_key("date").alias("month"), F.year("date").cast("bigint").alias("year")).agg(net.alias("net"))


def month_diffs(spark, sf):
    return rounded(joins.paired(month_net(spark, sf), ["month", "year"], "strategy", "N", "net"), ["difference"])


def t_two_sided_sql(stat: str, df: str) -> str:
    """Two-sided Student tail by Simpson's rule over the density."""
    x = f"(i * abs({stat}) / 2000.0::DOUBLE)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 2001), lambda i: ({weight}) * pow(1 + {x} * {x} / ({df}), -(({df}) + 1) / 2.0::DOUBLE))) * abs({stat}) / 2000 / 3"
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi()) * {area})"


T_STATS = """SELECT strategy, count(*) AS n, avg(difference) AS m, stddev_samp(difference) AS s FROM diffs GROUP BY 1"""


@query("paired_t_test", "L9 L13", twin("trades", f"""SELECT strategy, n, round(m, 4) AS mean_diff, round(s, 4) AS std_diff, round(m / (s / sqrt(n)), 6) AS t_stat, round({t_two_sided_sql('m / (s / sqrt(n))', '(n - 1)::DOUBLE')}, 6) AS p_value, round(m / s, 6) AS cohens_d FROM ({T_STATS})""", MONTH_NET))
def paired_t_test(spark, sf):
    made = ht.paired_t(month_diffs(spark, sf), ["strategy"]).drop("ci_low", "ci_high")
    return rounded(rounded(made, ["mean_diff", "std_diff"]), ["t_stat", "p_value", "cohens_d"], 6)


@query("paired_t_interval", "L9")
def paired_t_interval(spark, sf):
    return ht.paired_t(month_diffs(spark, sf), ["strategy"]).select("strategy", "n", "ci_low", "ci_high")


@query("sign_test", "L10", twin("trades", """SELECT strategy, n_positive, n, round(list_sum(list_transform(range(n_positive, n + 1), lambda i: exp(lgamma(n + 1.0::DOUBLE) - lgamma(i + 1.0::DOUBLE) - lgamma(n - i + 1.0::DOUBLE) - n * ln(2.0::DOUBLE)))), 6) AS p_value
  FROM (SELECT strategy, count(*) FILTER (WHERE difference > 0) AS n_positive, count(*) AS n FROM diffs GROUP BY 1)""", MONTH_NET))
def sign_test(spark, sf):
    return rounded(ht.sign_test(month_diffs(spark, sf), ["strategy"]), ["p_value"], 6)


@query("signed_rank_test", "L11", twin("trades", """SELECT strategy, count(*) AS n, sum(CASE WHEN difference > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN difference < 0 THEN rk ELSE 0 END) AS w_minus,
  round((sum(CASE WHEN difference > 0 THEN rk ELSE 0 END) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0::DOUBLE), 6) AS z
  FROM (SELECT *, CAST(rank() OVER (PARTITION BY strategy ORDER BY abs(difference)) AS DOUBLE) AS rk FROM diffs WHERE difference <> 0) GROUP BY 1""", MONTH_NET))
def signed_rank_test(spark, sf):
    return rounded(ht.signed_rank(month_diffs(spark, sf), ["strategy"]).drop("p_value"), ["w_plus", "w_minus", "z"], 6)


B = 10_000
BOOT_PICK = pick_sql(["b", "d.i"], "k.n", 21)


@query("bootstrap_interval", "L12", twin("trades", f"""SELECT z.strategy, round(quantile_cont(mb, 0.025), 4) AS ci_low, round(quantile_cont(mb, 0.975), 4) AS ci_high, round(max(o.m), 4) AS observed, max(o.n) AS n FROM (SELECT p.strategy, p.b, avg(v.difference) AS mb FROM
  (SELECT d.strategy, b, {BOOT_PICK} AS j FROM nums d JOIN (SELECT strategy, count(*) AS n FROM nums GROUP BY 1) k ON k.strategy = d.strategy, generate_series(1, {B}) g(b)) p JOIN nums v ON v.strategy = p.strategy AND v.i = p.j GROUP BY 1, 2) z
  JOIN (SELECT strategy, avg(difference) AS m, count(*) AS n FROM nums GROUP BY 1) o ON o.strategy = z.strategy GROUP BY 1""", MONTH_NET + ", nums AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY month) AS i FROM diffs)"))
def bootstrap_interval(spark, sf):
    made = rs.bootstrap_mean(month_diffs(spark, sf), ["strategy"], ["month"], "difference", n_replicates=B, seed=21)
    return rounded(made, ["ci_low", "ci_high", "observed"])


DAY_DIFFS = """day_net AS (SELECT strategy, date, sum(revenue - transaction_cost) AS net FROM trades GROUP BY 1, 2), day_diffs AS (SELECT a.strategy, a.date, round(a.net - b.net, 4) AS difference FROM day_net a JOIN day_net b ON a.date = b.date AND b.strategy = 'N' WHERE a.strategy <> 'N')"""


def day_diffs(spark, sf):
    net = F.sum(F.col("revenue") - F.col("transaction_cost"))
    daily = t.trades(spark, sf).groupBy("strategy", "date").agg(net.alias("net"))
    return rounded(joins.paired(daily, ["date"], "strategy", "N", "net"), ["difference"])


BLOCK_PICK = pick_sql(["b", "draw"], "n", 31)


@query("block_bootstrap_test", "L13", twin("trades", f"""SELECT strategy, round(max(observed), 4) AS observed, round(avg(CASE WHEN abs(m - observed) >= abs(observed) THEN 1 ELSE 0 END), 6) AS p_value, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high FROM (
  SELECT p.strategy, p.b, max(p.observed) AS observed, sum(k.s) / sum(k.c) AS m FROM (SELECT strategy, observed, b, {BLOCK_PICK} AS blk FROM tot, generate_series(1, n) d(draw), generate_series(1, {B}) g(b)) p LEFT JOIN blocks k ON k.strategy = p.strategy AND k.blk = p.blk GROUP BY 1, 2) GROUP BY 1""",
  DAY_DIFFS + """, blocks AS (SELECT strategy, date_diff('day', min(date) OVER (PARTITION BY strategy), date) // 30 + 1 AS blk, difference FROM day_diffs), blocks2 AS (SELECT 1)""").replace("blocks AS (SELECT strategy, date_diff", "raw_blocks AS (SELECT strategy, date_diff").replace("blocks2 AS (SELECT 1)", "blocks AS (SELECT strategy, blk, sum(difference) AS s, count(*) AS c FROM raw_blocks GROUP BY 1, 2), tot AS (SELECT strategy, max(blk) AS n, sum(s) / sum(c) AS observed FROM blocks GROUP BY 1)"))
def block_bootstrap_test(spark, sf):
    made = rs.block_bootstrap(day_diffs(spark, sf), ["strategy"], "difference", block_days=30, n_replicates=B, seed=31)
    return rounded(rounded(made, ["observed", "ci_low", "ci_high"]), ["p_value"], 6)


PERM = MONTH_NET + """, pooled AS (SELECT s.strategy, CASE WHEN m.strategy = 'N' THEN 0 ELSE 1 END AS g, m.month, round(m.net, 4) AS net FROM (SELECT DISTINCT strategy FROM months WHERE strategy <> 'N') s JOIN months m ON m.strategy = s.strategy OR m.strategy = 'N'),
  indexed AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY g, month) AS i FROM pooled), sizes AS (SELECT strategy, CAST(sum(g) AS BIGINT) AS n1, count(*) AS n, sum(net) AS total, avg(net) FILTER (WHERE g = 1) - avg(net) FILTER (WHERE g = 0) AS observed FROM indexed GROUP BY 1)"""


@query("permutation_test", "L14", twin("trades", f"""SELECT strategy, round(max(observed), 4) AS observed, round(avg(CASE WHEN abs(s1 / n1 - (total - s1) / (n - n1)) >= abs(observed) THEN 1 ELSE 0 END), 6) AS p_value FROM (
  SELECT x.strategy, x.b, max(n1) AS n1, max(n) AS n, max(total) AS total, max(observed) AS observed, sum(net) FILTER (WHERE p <= n1) AS s1 FROM (SELECT strategy, b, net, row_number() OVER (PARTITION BY strategy, b ORDER BY {mixed_sql(['b', 'i'], 41)}, i) AS p
  FROM indexed, generate_series(1, {B}) g(b)) x JOIN sizes z ON z.strategy = x.strategy GROUP BY 1, 2) GROUP BY 1""", PERM))
def permutation_test(spark, sf):
    rows = rounded(month_net(spark, sf), ["net"])
    base = rows.filter(F.col("strategy") == "N").select("month", "net")
    names = rows.filter(F.col("strategy") != "N").select("strategy").distinct()
    every = names.agg(F.collect_list("strategy")).scalar()
    pooled = rows.filter(F.col("strategy") != "N").select("strategy", F.lit(1).alias("g"), "month", "net").unionByName(
        base.select(F.explode(every).alias("strategy"), F.lit(0).alias("g"), "month", "net")
    )
    made = rs.permutation_test(pooled, ["strategy"], "g", ["month"], "net", n_replicates=B, seed=41)
    return rounded(rounded(made, ["observed"]), ["p_value"], 6)


ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
U = f"({mixed_sql(['b', *ROW_ID], 51)} % 1000000)"


@query("trade_bootstrap", "L15", twin("trades", f"""SELECT strategy, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high, round(max(o), 4) AS observed FROM (SELECT strategy, b, sum(revenue * w) / sum(amount * w) AS m FROM (
  SELECT strategy, b, revenue, amount, {' + '.join(f'CASE WHEN u >= {s} THEN 1 ELSE 0 END' for s in rs.POISSON_STEPS)} AS w FROM (SELECT strategy, b, revenue, amount, {U} AS u FROM trades, generate_series(1, 1000) g(b))) GROUP BY 1, 2) JOIN (SELECT strategy, sum(revenue) / sum(amount) AS o FROM trades GROUP BY 1) USING (strategy) GROUP BY 1"""))
def trade_bootstrap(spark, sf):
    made = rs.poisson_bootstrap(t.trades(spark, sf), ["strategy"], ROW_ID, "revenue", "amount", n_replicates=1000, seed=51)
    return rounded(made, ["ci_low", "ci_high", "observed"])


@query("clustered_mean_test", "L16", twin("trades", f"""SELECT strategy, n, n_clusters, round(mu, 4) AS mean_diff, round(se, 4) AS se, round(mu / se, 6) AS t_stat, round({t_two_sided_sql('mu / se', '(n_clusters - 1)::DOUBLE')}, 6) AS p_value FROM (
  SELECT strategy, n, n_clusters, mu, sqrt(n_clusters / (n_clusters - 1.0::DOUBLE) * sum((s - c * mu) * (s - c * mu))) / n AS se FROM (SELECT *, sum(s) OVER w / sum(c) OVER w AS mu, CAST(sum(c) OVER w AS BIGINT) AS n, count(*) OVER w AS n_clusters
  FROM (SELECT strategy, year(date) AS y, sum(difference) AS s, count(*) AS c FROM counter GROUP BY 1, 2) WINDOW w AS (PARTITION BY strategy)) GROUP BY 1, 2, 3, 4)""", COUNTER))
def clustered_mean_test(spark, sf):
    made = ht.clustered_mean(counterfactual(spark, sf), ["strategy"], "year")
    return rounded(rounded(made, ["mean_diff", "se"]), ["t_stat", "p_value"], 6)


@query("clustered_group_difference", "L17", twin("trades", f"""SELECT strategy, n1, n0, n_clusters, round(m1 - m0, 4) AS effect, round(se, 4) AS se, round((m1 - m0) / se, 6) AS t_stat, round({t_two_sided_sql('(m1 - m0) / se', '(n_clusters - 1)::DOUBLE')}, 6) AS p_value FROM (
  SELECT strategy, n1, n0, m1, m0, n_clusters, sqrt(sum(pow((s1 - c1 * m1) / n1 - (s0 - c0 * m0) / n0, 2)) * n_clusters / (n_clusters - 1.0::DOUBLE) * (n1 + n0 - 1) / (n1 + n0 - 2.0::DOUBLE)) AS se FROM (
  SELECT *, CAST(sum(c1) OVER w AS BIGINT) AS n1, CAST(sum(c0) OVER w AS BIGINT) AS n0, sum(s1) OVER w / sum(c1) OVER w AS m1, sum(s0) OVER w / sum(c0) OVER w AS m0, count(*) OVER w AS n_clusters FROM (
  SELECT s.strategy, m.year, coalesce(sum(net) FILTER (WHERE m.strategy <> 'N'), 0) AS s1, count(*) FILTER (WHERE m.strategy <> 'N') AS c1, coalesce(sum(net) FILTER (WHERE m.strategy = 'N'), 0) AS s0, count(*) FILTER (WHERE m.strategy = 'N') AS c0
  FROM (SELECT DISTINCT strategy FROM months WHERE strategy <> 'N') s JOIN months m ON m.strategy = s.strategy OR m.strategy = 'N' GROUP BY 1, 2) WINDOW w AS (PARTITION BY strategy)) GROUP BY 1, 2, 3, 4, 5, 6)""", MONTH_NET))
def clustered_group_difference(spark, sf):
    rows = month_net(spark, sf)
    every = rows.filter(F.col("strategy") != "N").select("strategy").distinct().agg(F.collect_list("strategy")).scalar()
    treated = rows.filter(F.col("strategy") != "N").select("strategy", F.lit(1).alias("treated"), "year", "net")
    control = rows.filter(F.col("strategy") == "N").select(F.explode(every).alias("strategy"), F.lit(0).alias("treated"), "year", "net")
    made = ht.clustered_group_difference(treated.unionByName(control), ["strategy"], "treated", "year", "net")
    return rounded(rounded(made, ["effect", "se"]), ["t_stat", "p_value"], 6)


HAC_ROWS = DAILY_RETS + """, centred AS (SELECT strategy, date, ret - avg(ret) OVER (PARTITION BY strategy) AS e, avg(ret) OVER (PARTITION BY strategy) AS m, count(*) OVER (PARTITION BY strategy) AS n FROM day_rets WHERE ret IS NOT NULL),
  hac AS (SELECT strategy, n, m, sqrt(sum(e * e""" + "".join(f" + 2 * {1 - k / 31}::DOUBLE * e * coalesce(e{k}, 0)" for k in range(1, 31)) + """)) / n AS se FROM (SELECT *, """ + ", ".join(f"lag(e, {k}) OVER (PARTITION BY strategy ORDER BY date) AS e{k}" for k in range(1, 31)) + """ FROM centred) GROUP BY 1, 2, 3)"""


@query("hac_mean_test", "L18", twin("trades", f"SELECT strategy, n, round(m * 1000000, 3) AS mean_ppm, round(se * 1000000, 3) AS se_ppm, round(m / se, 6) AS t_stat, round({t_two_sided_sql('m / se', '(n - 1)::DOUBLE')}, 6) AS p_value FROM hac", HAC_ROWS))
def hac_mean_test(spark, sf):
    from pyspark.sql import Window

    values = lg.net_value(daily_state(spark, sf))
    before = F.lag("net_value").over(Window.partitionBy("strategy").orderBy("date"))
    rets = values.select("strategy", "date", (F.col("net_value") / F.nullif(before, F.lit(0.0)) - 1).alias("ret"))
    made = ht.hac_mean(rets, ["strategy"], "ret", lags=30)
    return made.select("strategy", "n", r(F.col("mean") * 1000000, 3).alias("mean_ppm"), r(F.col("hac_se") * 1000000, 3).alias("se_ppm"), r("t_stat", 6).alias("t_stat"), r("p_value", 6).alias("p_value"))


FAMILY = MONTH_NET + f""", tested AS (SELECT strategy, year, round({t_two_sided_sql('m / (s / sqrt(n))', '(n - 1)::DOUBLE')}, 6) AS p FROM (SELECT strategy, year, count(*) AS n, avg(difference) AS m, stddev_samp(difference) AS s FROM diffs GROUP BY 1, 2) WHERE n > 2)"""


@query("multiple_testing", "L19", twin("trades", """SELECT strategy, year, p, round(least(p * n, 1), 6) AS bonferroni, round(least(max((n - i + 1) * p) OVER (PARTITION BY strategy ORDER BY i ROWS UNBOUNDED PRECEDING), 1), 6) AS holm,
  round(least(min(p * n / i) OVER (PARTITION BY strategy ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bh FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY p, year) AS i, count(*) OVER (PARTITION BY strategy) AS n FROM tested)""", FAMILY))
def multiple_testing(spark, sf):
    tested = ht.paired_t(month_diffs(spark, sf), ["strategy", "year"]).filter(F.col("n") > 2).select("strategy", "year", r("p_value", 6).alias("p"))
    return rounded(ht.corrected(tested, ["strategy"], "p", "year"), ["bonferroni", "holm", "bh"], 6)


@query("normality", "L20 A8", twin("trades", """SELECT strategy, n, round(sk, 5) AS skew, round(ku, 5) AS kurt, round(n / 6.0 * (sk * sk + ku * ku / 4), 4) AS jarque_bera, round(exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2), 6) AS p_value FROM (
  SELECT strategy, count(*) AS n, avg(pow(d, 3)) / pow(avg(d * d), 1.5) AS sk, avg(pow(d, 4)) / pow(avg(d * d), 2) - 3 AS ku FROM (SELECT strategy, difference - avg(difference) OVER (PARTITION BY strategy) AS d FROM diffs) GROUP BY 1)""", MONTH_NET))
def normality(spark, sf):
    made = ht.normality(month_diffs(spark, sf), ["strategy"], "difference")
    return rounded(rounded(rounded(made, ["skew", "kurt"], 5), ["jarque_bera"]), ["p_value"], 6)


PERIODS = """keys AS (SELECT strategy, 'month' AS granularity, strftime(date, '%Y-%m') AS period, revenue - transaction_cost AS v FROM trades UNION ALL SELECT strategy, 'quarter', year(date) || '-Q' || quarter(date), revenue - transaction_cost FROM trades
  UNION ALL SELECT strategy, 'year', CAST(year(date) AS VARCHAR), revenue - transaction_cost FROM trades), nets AS (SELECT strategy, granularity, period, sum(v) AS net FROM keys GROUP BY 1, 2, 3),
  gdiffs AS (SELECT a.strategy, a.granularity, a.net - b.net AS d FROM nets a JOIN nets b USING (granularity, period) WHERE b.strategy = 'N' AND a.strategy <> 'N')"""


@query("multi_granularity_test", "L24", twin("trades", f"""SELECT strategy, granularity, n, round(m, 3) AS mean_diff, round(m / (s / sqrt(n)), 6) AS t_stat, round({t_two_sided_sql('m / (s / sqrt(n))', '(n - 1)::DOUBLE')}, 6) AS p_value FROM (SELECT strategy, granularity, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM gdiffs GROUP BY 1, 2)""", PERIODS))
def multi_granularity_test(spark, sf):
    net = F.sum(F.col("revenue") - F.col("transaction_cost"))
    daily = t.trades(spark, sf).groupBy("strategy", "date").agg(net.alias("net"))
    nets = daily.select("strategy", F.inline(dates.period_keys("date")), "net").groupBy("strategy", "granularity", "period").agg(F.sum("net").alias("net"))
    made = ht.paired_t(joins.paired(nets, ["granularity", "period"], "strategy", "N", "net"), ["strategy", "granularity"])
    made = made.select("strategy", "granularity", "n", "mean_diff", "t_stat", "p_value")
    return rounded(rounded(made, ["mean_diff"], 3), ["t_stat", "p_value"], 6)


@query("monthly_excess_test", "L26", twin("trades", f"""SELECT strategy, n, round(m * 1000000, 5) AS mean_excess_ppm, round(m / (s / sqrt(n)), 6) AS t_stat, round(CASE WHEN m > 0 THEN {t_two_sided_sql('m / (s / sqrt(n))', '(n - 1)::DOUBLE')} / 2 ELSE 1 - {t_two_sided_sql('m / (s / sqrt(n))', '(n - 1)::DOUBLE')} / 2 END, 6) AS p_value,
  round(win, 6) AS win_rate, round(m / sp * sqrt(12), 6) AS sharpe FROM (SELECT strategy, count(*) AS n, avg(excess) AS m, stddev_samp(excess) AS s, stddev_pop(excess) AS sp, avg(CASE WHEN excess > 0 THEN 1 ELSE 0 END) AS win FROM excess GROUP BY 1)""", MONTHLY))
def monthly_excess_test(spark, sf):
    made = ht.monthly_excess_test(monthly_excess(spark, sf), ["strategy"])
    return made.select("strategy", "n", r(F.col("mean_excess") * 1000000, 5).alias("mean_excess_ppm"), r("t_stat", 6).alias("t_stat"), r("p_value", 6).alias("p_value"), r("win_rate", 6).alias("win_rate"), r("sharpe", 6).alias("sharpe"))
