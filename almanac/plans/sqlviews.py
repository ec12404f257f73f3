"""Shared SQL building blocks for the twins: named sub-queries with their dependencies."""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {
    # name -> (names it needs, text)
    "bars": (
        "",
        """SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS date,
             arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
             arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS BIGINT) AS volume
           FROM orders GROUP BY 1, 2""",
    ),
    "days": (
        "bars",
        """SELECT CAST(unnest(generate_series((SELECT min(date) FROM bars), (SELECT max(date) FROM bars),
             INTERVAL 1 DAY)) AS DATE) AS date""",
    ),
    "spine": ("bars days", "SELECT entity, date FROM (SELECT DISTINCT entity FROM bars) e, days"),
    "grid": (
        "bars spine",
        """SELECT s.entity, s.date, b.open, b.high, b.low, b.close, b.volume
           FROM spine s LEFT JOIN bars b ON b.entity = s.entity AND b.date = s.date""",
    ),
    "filled": (
        "grid",
        """SELECT entity, date, close IS NOT NULL AS traded,
             last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high,
             last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close,
             coalesce(volume, 0) AS volume
           FROM grid WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    ),
    "series": ("filled", "SELECT * FROM filled WHERE close IS NOT NULL"),
    "global_raw": (
        "",
        """SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_discount) * 100, 6) AS vix
           FROM lineitem GROUP BY 1""",
    ),
    "fx_raw": (
        "",
        """SELECT CAST(o_orderdate AS DATE) AS date,
             max(CASE WHEN r_name = 'AFRICA' THEN o_totalprice END) AS africa_usd,
             max(CASE WHEN r_name = 'AMERICA' THEN o_totalprice END) AS america_usd,
             max(CASE WHEN r_name = 'ASIA' THEN o_totalprice END) AS asia_usd,
             max(CASE WHEN r_name = 'EUROPE' THEN o_totalprice END) AS europe_usd,
             max(CASE WHEN r_name = 'MIDDLE EAST' THEN o_totalprice END) AS mideast_usd
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
             JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
    ),
    "regional": (
        "",
        """SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS entity, n_name AS region,
             max(o_totalprice) AS temp_max_c, min(o_totalprice) AS temp_min_c,
             CAST(count(*) AS BIGINT) AS n_orders, max(c_acctbal) AS precipitation_mm
           FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
           GROUP BY 1, 2, 3""",
    ),
    "news": (
        "",
        """SELECT event_id, CAST(ts AS DATE) AS article_date, ts, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS entity,
             event_type AS theme, value AS tone, CAST(json_extract_string(props, '$.k') AS BIGINT) AS words
           FROM events""",
    ),
    "themed": (
        "news",
        """SELECT *, CASE theme WHEN 'view' THEN 'SUPPLY' WHEN 'click' THEN 'MARKET' WHEN 'signup' THEN 'TRADE'
             WHEN 'error' THEN 'LOGISTICS' ELSE 'OTHER' END AS theme_group FROM news""",
    ),
    # forecasts: every seventh day of the walk, three models, fourteen horizons, 2,000 paths in a list
    "walk": (
        "series",
        """SELECT entity, date, close,
             row_number() OVER (PARTITION BY entity ORDER BY date) AS t,
             first_value(close) OVER (PARTITION BY entity ORDER BY date) AS close0,
             round(avg(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS mean30
           FROM series""",
    ),
    "origins": (
        "walk",
        """SELECT entity, date AS origin, close AS spot, mean30, CASE WHEN t > 1 THEN (close - close0) / (t - 1) ELSE 0 END AS drift
           FROM walk WHERE t >= 31 AND (t - 31) % 7 = 0""",
    ),
    "paths": (
        "origins",
        """SELECT entity, origin, model, horizon, spot, target_date,
             list_transform(range(1, 2001), lambda p: centre * (1 + (((p * 7919 + base) % 2001) - 1000) / 20011.0::DOUBLE)) AS prices
           FROM (SELECT entity, origin, model, h AS horizon, spot, CAST(origin + CAST(h AS INTEGER) AS DATE) AS target_date,
               h * 104729 + m * 1299709 AS base, CASE model WHEN 'naive' THEN spot WHEN 'drift' THEN spot + h * drift ELSE mean30 END AS centre
             FROM origins, (VALUES ('naive', 1), ('drift', 2), ('mean30', 3)) models(model, m), generate_series(1, 14) hs(h))""",
    ),
    "scored": (
        "paths series",
        """SELECT p.*, s.close AS actual FROM paths p JOIN series s ON s.entity = p.entity AND s.date = p.target_date""",
    ),
    "medians": (
        "scored",
        """SELECT entity, model, origin, horizon, target_date, spot, actual, list_aggregate(prices, 'quantile_cont', 0.5) AS median_price FROM scored""",
    ),
    # ledger: sales by day; the return flag names the strategy
    "trades": (
        "",
        """SELECT l_returnflag AS strategy, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_suppkey,
             l_quantity AS amount, l_extendedprice AS revenue, round(l_extendedprice * l_tax, 4) AS transaction_cost,
             l_extendedprice / l_quantity AS price
           FROM lineitem""",
    ),
}


def _needs(name: str, seen: list[str]) -> list[str]:
    for dependency in VIEWS[name][0].split():
        _needs(dependency, seen)
    if name not in seen:
        seen.append(name)
    return seen


def twin(views: str, body: str, extra: str = "") -> str:
    """Assemble ``WITH`` views (and ``extra`` ones written in place) in front of ``body``."""
    names: list[str] = []
    for view in views.split():
        _needs(view, names)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in names]
    if extra.strip():
        parts.append(extra.strip())
    return f"WITH {', '.join(parts)} {body}" if parts else body
