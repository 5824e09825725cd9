"""The same results as ANSI SQL over the shared tables."""

from __future__ import annotations

from tsquant.plans.views import SHOCKS

BAR = "open, high, low, close, volume"

TICKS = """ticks AS (
    SELECT event_type AS symbol, ts AS "timestamp", value AS price, event_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume
    FROM events)"""


def _bars(name: str, source: str, start: str, order: str) -> str:
    return f"""{name} AS (
    SELECT symbol, strftime({start}, '%Y-%m') AS date_bucket, {start} AS "timestamp",
           arg_min(price, {order}) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, {order}) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM {source} GROUP BY symbol, {start})"""


def _coarser(name: str, source: str, unit: str) -> str:
    start = f"CAST(date_trunc('{unit}', \"timestamp\") AS TIMESTAMP)"
    return f"""{name} AS (
    SELECT symbol, strftime({start}, '%Y-%m') AS date_bucket, {start} AS "timestamp",
           arg_min(open, "timestamp") AS open, max(high) AS high, min(low) AS low,
           arg_max(close, "timestamp") AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM {source} GROUP BY symbol, {start})"""


HOURLY = TICKS + ",\n" + _bars(
    "bars", "ticks", "date_trunc('hour', \"timestamp\")", '("timestamp", event_id)'
)
TRADES = """trades AS (
    SELECT o_orderpriority AS symbol, o_orderdate AS "timestamp", o_totalprice AS price,
           CAST(1 AS BIGINT) AS volume, o_orderkey
    FROM orders)"""
DAILY = TRADES + ",\n" + _bars(
    "bars", "trades", "CAST(date_trunc('day', \"timestamp\") AS TIMESTAMP)", '("timestamp", o_orderkey)'
)
W = 'PARTITION BY symbol ORDER BY "timestamp"'


def last(rows: int) -> str:
    return f"({W} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def six(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def bar_columns(columns: str = BAR) -> str:
    return ", ".join(c if c == "volume" else six(c, c) for c in columns.split(", "))


# Exponential averages by recursion over numbered rows.


def _numbered(source: str, price: str, order: str) -> str:
    return f"""numbered AS (
    SELECT *, {price} AS x,
           row_number() OVER (PARTITION BY symbol ORDER BY {order}) AS rn
    FROM {source})"""


MACD_RECURSION = """walk AS (
    SELECT symbol, rn, x AS fast, x AS slow, CAST(0 AS DOUBLE) AS signal
    FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.symbol, n.rn,
           n.x * (2.0::DOUBLE / 13) + w.fast * (11.0::DOUBLE / 13),
           n.x * (2.0::DOUBLE / 27) + w.slow * (25.0::DOUBLE / 27),
           ((n.x * (2.0::DOUBLE / 13) + w.fast * (11.0::DOUBLE / 13))
            - (n.x * (2.0::DOUBLE / 27) + w.slow * (25.0::DOUBLE / 27))) * 0.2::DOUBLE
           + w.signal * 0.8::DOUBLE
    FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"""

EMA_RECURSION = """walk AS (
    SELECT symbol, rn, x AS ema FROM numbered WHERE rn = 1
    UNION ALL
    SELECT n.symbol, n.rn, n.x * (2.0::DOUBLE / 13) + w.ema * (11.0::DOUBLE / 13)
    FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.rn = w.rn + 1)"""

MACD_COLUMNS = ", ".join(
    [
        six("fast", '"EMA_12"'),
        six("slow", '"EMA_26"'),
        six("fast - slow", '"MACD"'),
        six("signal", '"MACD_Signal"'),
        six("fast - slow - signal", '"MACD_Histogram"'),
    ]
)


def _spread(deviation: str) -> str:
    return f"""
    SELECT symbol, "timestamp", {six(f'avg(close) OVER {last(20)}', 'bollinger_middle')},
           {six(f'avg(close) OVER {last(20)} + 2 * {deviation}(close) OVER {last(20)}', 'bollinger_upper')},
           {six(f'avg(close) OVER {last(20)} - 2 * {deviation}(close) OVER {last(20)}', 'bollinger_lower')}
    FROM bars"""


CHANGES = f"""changes AS (
    SELECT *, close - lag(close) OVER ({W}) AS change FROM bars),
averages AS (
    SELECT symbol, "timestamp", close,
           avg(CASE WHEN change > 0 THEN change ELSE 0.0 END) OVER {last(14)} AS gain,
           avg(CASE WHEN change < 0 THEN -change ELSE 0.0 END) OVER {last(14)} AS loss
    FROM changes)"""
RSI = "CASE WHEN loss = 0 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END"

RANGES = f"""ranges AS (
    SELECT *, max(high) OVER {last(14)} AS top, min(low) OVER {last(14)} AS bottom FROM bars),
ratios AS (
    SELECT symbol, "timestamp",
           CASE WHEN top = bottom THEN 50.0 ELSE (close - bottom) / (top - bottom) * 100 END AS k
    FROM ranges)"""

SIGNED = f"""signed AS (
    SELECT symbol, "timestamp", close, volume,
           CASE WHEN close > lag(close) OVER ({W}) THEN volume
                WHEN close < lag(close) OVER ({W}) THEN -volume ELSE 0 END AS step
    FROM bars)"""
OBV = f"CAST(sum(step) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"

ENRICHED = (
    f"WITH RECURSIVE {HOURLY},\n{_numbered('bars', 'close', chr(34) + 'timestamp' + chr(34))},\n"
    f"{MACD_RECURSION},\n{CHANGES},\n{RANGES},\n{SIGNED},\n"
    f"""enriched AS (
    SELECT n.symbol, n."timestamp", {six(f'avg(n.close) OVER {last(20)}'.replace('symbol', 'n.symbol').replace('"timestamp"', 'n."timestamp"'), '"SMA_20"')},
           b.bollinger_middle, b.bollinger_upper, b.bollinger_lower, {six(RSI, '"RSI_14"')},
           {MACD_COLUMNS}, s.stochastic_k_14, s.stochastic_d_14_3, o."OBV"
    FROM numbered n
    JOIN walk w ON w.symbol = n.symbol AND w.rn = n.rn
    JOIN averages a ON a.symbol = n.symbol AND a."timestamp" = n."timestamp"
    JOIN ({_spread('stddev_samp')}) b ON b.symbol = n.symbol AND b."timestamp" = n."timestamp"
    JOIN (SELECT symbol, "timestamp", {six('k', 'stochastic_k_14')},
                 {six(f'avg(k) OVER {last(3)}', 'stochastic_d_14_3')} FROM ratios) s
      ON s.symbol = n.symbol AND s."timestamp" = n."timestamp"
    JOIN (SELECT symbol, "timestamp", {OBV} AS "OBV" FROM signed) o
      ON o.symbol = n.symbol AND o."timestamp" = n."timestamp")"""
)

# value type, column, indicator type
RECORD_COLUMNS = [
    ("SMA", "value", "SMA_20"),
    ("BOLLINGER", "upper", "bollinger_upper"),
    ("BOLLINGER", "middle", "bollinger_middle"),
    ("BOLLINGER", "lower", "bollinger_lower"),
    ("RSI", "value", "RSI_14"),
    ("MACD", "line", "MACD"),
    ("MACD", "signal", "MACD_Signal"),
    ("MACD", "histogram", "MACD_Histogram"),
    ("EMA", "value", "EMA_12"),
    ("STOCHASTIC", "k", "stochastic_k_14"),
    ("STOCHASTIC", "d", "stochastic_d_14_3"),
    ("OBV", "value", "OBV"),
]
PARAMETERS = [
    ("SMA", "period", 20),
    ("BOLLINGER", "period", 20),
    ("BOLLINGER", "stddev", 2),
    ("RSI", "period", 14),
    ("MACD", "fast", 12),
    ("MACD", "slow", 26),
    ("MACD", "signal", 9),
    ("EMA", "period", 12),
    ("EMA", "smoothing", 2),
    ("STOCHASTIC", "k", 14),
    ("STOCHASTIC", "d", 3),
]


def _records(types: tuple[str, ...] | None = None) -> str:
    rows = [
        f"SELECT symbol, \"timestamp\", strftime(\"timestamp\", '%Y-%m') AS date_bucket,"
        f" '{kind}' AS indicator_type, '{name}' AS name, CAST(\"{column}\" AS DOUBLE) AS value"
        f" FROM enriched"
        for kind, name, column in RECORD_COLUMNS
        if types is None or kind in types
    ]
    return ENRICHED + "\n" + "\nUNION ALL ".join(rows)


UNPIVOTED = ENRICHED + "\n" + "\nUNION ALL ".join(
    f"SELECT symbol, \"timestamp\", '{column}' AS indicator_name,"
    f' CAST("{column}" AS DOUBLE) AS indicator_value FROM enriched'
    for _, _, column in RECORD_COLUMNS
)

# Payload faults as predicates on the day of the month and the volume.
DAYS = HOURLY + """,
faulty AS (
    SELECT *, CAST("timestamp" AS DATE) AS day, day("timestamp") AS dom FROM bars),
copies AS (SELECT unnest([1, 2]) AS copy),
landed AS (SELECT * FROM faulty, copies WHERE copy = 1 OR dom % 6 = 2),
sent AS (
    SELECT symbol, day, dom, copy, count(*) AS n, epoch(min("timestamp"))::BIGINT AS first_at
    FROM landed GROUP BY symbol, day, dom, copy)"""
SOUND = "dom % 7 <> 0"
ALIGNED = SOUND + " AND dom % 11 <> 3 AND dom <> 30"
NULLED = "CASE WHEN volume % 10 <> 0 THEN close END"


def _shapes(condition: str) -> str:
    size = "CASE WHEN dom <> 30 THEN n END"
    arrays = ", ".join(f"{size} AS {a}" for a in ("timestamps", "opens", "closes", "highs", "lows"))
    return f"""WITH {DAYS}
    SELECT symbol AS company_symbol, CASE WHEN dom <> 30 THEN first_at END AS first_at, {arrays},
           CASE WHEN dom <> 30 THEN n - CASE WHEN dom % 11 = 3 THEN 1 ELSE 0 END END AS volumes
    FROM sent WHERE {condition}"""


def _exploded(condition: str, source: str = "landed") -> str:
    return f"""WITH {DAYS}
    SELECT symbol, date_bucket, "timestamp", {six('open', 'open')}, {six('high', 'high')},
           {six('low', 'low')}, {six(NULLED, 'close')}, volume
    FROM {source} WHERE {condition}"""


CHANGE = f"""change AS (
    SELECT symbol, "timestamp", close / lag(close) OVER ({W}) - 1 AS simple_return,
           ln(close / lag(close) OVER ({W})) AS log_return
    FROM bars)"""


def _correlations() -> str:
    ctes, rows = [DAILY], []
    for unit in ("day", "week", "month"):
        ctes.append(_coarser(f"by_{unit}", "bars", unit))
        ctes.append(
            f"""moves_{unit} AS (
    SELECT symbol, "timestamp", ln(close / lag(close) OVER ({W})) AS r FROM by_{unit})"""
        )
        rows.append(
            f"""SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, '{unit}' AS period,
           {six('corr(a.r, b.r)', 'correlation')}, count(*) AS n
    FROM moves_{unit} a JOIN moves_{unit} b
      ON a."timestamp" = b."timestamp" AND a.symbol < b.symbol
    WHERE a.r IS NOT NULL AND b.r IS NOT NULL
    GROUP BY a.symbol, b.symbol"""
        )
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


SCORES = """scores AS (
    SELECT event_type AS symbol, ts AS "timestamp", value AS sentiment_score, event_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS size
    FROM events)"""


def _age(seconds: int, name: str) -> str:
    frame = f"({W} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {seconds} SECONDS PRECEDING)"
    return six(f"sentiment_score - last_value(sentiment_score) OVER {frame}", name)


def _daily_sentiment(keys: str) -> str:
    return f"""WITH {SCORES}
    SELECT {keys}CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date_bucket,
           {six('sum((size % 10 + 1) * sentiment_score) / sum(size % 10 + 1)', 'sentiment_score')},
           count(*) AS articles
    FROM scores GROUP BY ALL"""


SHOCK_ROWS = ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in SHOCKS)

PARTS = """parts AS (
    SELECT *, 'S' || (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4) AS sector
    FROM part)"""

# A later tick closes the windows of all bars.
STREAMED = HOURLY + ", closed AS (SELECT * FROM bars)"

FEATURES = f"""features AS (
    SELECT symbol, "timestamp", close, avg(close) OVER {last(5)} AS sma,
           {RSI} AS rsi
    FROM averages)"""

ORACLES: dict[str, str] = {
    "bars_from_ticks": f'WITH {HOURLY} SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM bars',
    "resample_bars": f"""WITH {HOURLY}, {_coarser('days', 'bars', 'day')}
    SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM days""",
    "resample_bars_month": f"""WITH {DAILY}, {_coarser('months', 'bars', 'month')}
    SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM months""",
    "resample_bars_week": f"""WITH {DAILY}, {_coarser('weeks', 'bars', 'week')}
    SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM weeks""",
    "apply_retention": f"""WITH {DAILY} SELECT symbol, "timestamp", {bar_columns()} FROM bars
    WHERE "timestamp" >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAYS""",
    "latest_bars": f"""WITH {DAILY} SELECT symbol, "timestamp", {bar_columns()} FROM bars
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 5""",
    "newest_bars": f"""WITH {DAILY} SELECT symbol, "timestamp", {bar_columns()} FROM bars
    QUALIFY row_number() OVER (ORDER BY "timestamp" DESC, symbol DESC) <= 25""",
    "read_chart_payloads": f"""WITH {DAYS}
    SELECT CASE symbol WHEN 'view' THEN 'MC.PA' WHEN 'click' THEN '0700' ELSE symbol END AS requested_symbol,
           dom % 7 = 0 AS corrupt,
           CASE WHEN {SOUND} AND dom <> 30 AND dom % 5 <> 1 THEN symbol END AS stated_symbol,
           CASE WHEN {SOUND} AND dom <> 30 THEN n END AS bars,
           CASE WHEN {SOUND} AND dom <> 30 THEN first_at END AS first_at
    FROM sent""",
    "read_bars": f"""WITH {DAILY} SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM bars
    WHERE symbol IN ('1-URGENT', '5-LOW') AND date_bucket BETWEEN '1996-03' AND '1997-02'""",
    "newest_load": f"""WITH {DAILY}
    SELECT symbol, "timestamp", {six('close', 'close')},
           volume + CASE WHEN date_bucket = '1996-03' THEN 100 ELSE 0 END AS volume
    FROM bars WHERE date_bucket BETWEEN '1996-01' AND '1996-06'""",
    "upsert_bars": f"""WITH {DAILY}
    SELECT symbol, "timestamp", {bar_columns('open, high, low, close')},
           volume + CASE WHEN date_bucket = '1996-02' THEN 100 ELSE 0 END AS volume FROM bars""",
    "trim_bars": f"""WITH {DAILY} SELECT symbol, "timestamp", {bar_columns()} FROM bars
    WHERE "timestamp" >= TIMESTAMP '2001-08-01' - INTERVAL 100 DAYS""",
    "write_indicators": _records(("RSI", "MACD", "OBV")),
    "read_quote_csv": f"""WITH {DAILY}
    SELECT symbol, {six('close', 'price')}, {six('high', 'high')}, {six('low', 'low')}, "timestamp"
    FROM bars""",
    "corrupt_report": f"""WITH {DAYS}
    SELECT count(*) FILTER (dom % 7 = 0) AS corrupt, count(*) AS total,
           {six('coalesce(count(*) FILTER (dom % 7 = 0) * 100.0::DOUBLE / nullif(count(*), 0), 0)', 'percent')}
    FROM sent""",
    "drop_corrupt": f"""WITH {DAYS}
    SELECT symbol AS requested_symbol, CAST(day AS VARCHAR) AS day FROM sent WHERE {SOUND}""",
    "extract_chart": _shapes(SOUND),
    "keep_aligned_arrays": _shapes(ALIGNED),
    "explode_bars": _exploded(ALIGNED),
    "drop_null_rows": _exploded(f"{ALIGNED} AND volume % 10 <> 0"),
    "dedup_bars": _exploded(ALIGNED, "faulty"),
    "clean_bars": _exploded(f"{ALIGNED} AND volume % 10 <> 0", "faulty"),
    "sma": f"""WITH {HOURLY}
    SELECT symbol, "timestamp", {six(f'avg(close) OVER {last(20)}', '"SMA_20"')} FROM bars""",
    "sma_strict": f"""WITH {HOURLY}
    SELECT symbol, "timestamp",
           {six(f'CASE WHEN count(*) OVER {last(20)} >= 20 THEN avg(close) OVER {last(20)} END', '"SMA_20"')}
    FROM bars""",
    "rolling_stddev": f"""WITH {HOURLY}
    SELECT symbol, "timestamp", {six(f'avg(close) OVER {last(20)}', '"SMA_20"')},
           {six(f'stddev_samp(close) OVER {last(20)}', '"StdDev_20"')}
    FROM bars""",
    "rolling_stddev_pop": f"""WITH {HOURLY}
    SELECT symbol, "timestamp", {six(f'avg(close) OVER {last(20)}', '"SMA_20"')},
           {six(f'stddev_pop(close) OVER {last(20)}', '"StdDev_20"')}
    FROM bars""",
    "bollinger": f"WITH {HOURLY} {_spread('stddev_samp')}",
    "bollinger_pop": f"WITH {HOURLY} {_spread('stddev_pop')}",
    "ema_one_step": f"""WITH {HOURLY},
    means AS (SELECT *, avg(close) OVER {last(12)} AS mean FROM bars)
    SELECT symbol, "timestamp",
           {six(f'coalesce(close * (2.0::DOUBLE / 13) + lag(mean) OVER ({W}) * (11.0::DOUBLE / 13), mean)', '"EMA_12"')}
    FROM means""",
    "macd_one_step": f"""WITH {HOURLY},
    means AS (
        SELECT *, avg(close) OVER {last(12)} AS fast_mean, avg(close) OVER {last(26)} AS slow_mean
        FROM bars),
    steps AS (
        SELECT *, coalesce(close * (2.0::DOUBLE / 13) + lag(fast_mean) OVER ({W}) * (11.0::DOUBLE / 13), fast_mean) AS fast,
               coalesce(close * (2.0::DOUBLE / 27) + lag(slow_mean) OVER ({W}) * (25.0::DOUBLE / 27), slow_mean) AS slow
        FROM means),
    lines AS (SELECT *, avg(fast - slow) OVER {last(9)} AS line_mean FROM steps),
    signals AS (
        SELECT *, coalesce((fast - slow) * 0.2::DOUBLE + lag(line_mean) OVER ({W}) * 0.8::DOUBLE, line_mean) AS signal
        FROM lines)
    SELECT symbol, "timestamp", {MACD_COLUMNS} FROM signals""",
    "ema": f"""WITH RECURSIVE {TICKS}, {_numbered('ticks', 'price', '"timestamp", event_id')}, {EMA_RECURSION}
    SELECT n.symbol, n."timestamp", n.event_id, {six('w.ema', '"EMA_12"')}
    FROM numbered n JOIN walk w ON w.symbol = n.symbol AND w.rn = n.rn""",
    "macd": f"""WITH RECURSIVE {TICKS}, {_numbered('ticks', 'price', '"timestamp", event_id')}, {MACD_RECURSION}
    SELECT n.symbol, n."timestamp", n.event_id, {MACD_COLUMNS}
    FROM numbered n JOIN walk w ON w.symbol = n.symbol AND w.rn = n.rn""",
    "rsi": f"""WITH {HOURLY}, {CHANGES}
    SELECT symbol, "timestamp", {six(RSI, '"RSI_14"')} FROM averages""",
    "stochastic": f"""WITH {HOURLY}, {RANGES}
    SELECT symbol, "timestamp", {six('k', 'stochastic_k_14')},
           {six(f'avg(k) OVER {last(3)}', 'stochastic_d_14_3')}
    FROM ratios""",
    "stochastic_strict": f"""WITH {HOURLY}, {RANGES}
    SELECT symbol, "timestamp", {six('k', 'stochastic_k_14')},
           {six(f'CASE WHEN count(*) OVER {last(3)} >= 3 THEN avg(k) OVER {last(3)} END', 'stochastic_d_14_3')}
    FROM ratios""",
    "obv": f"""WITH {HOURLY}, {SIGNED} SELECT symbol, "timestamp", {OBV} AS "OBV" FROM signed""",
    "obv_step": f"""WITH {HOURLY}, {SIGNED}
    SELECT symbol, "timestamp", {OBV} AS "OBV" FROM signed
    QUALIFY row_number() OVER ({W}) > 1""",
    "obv_two_step": f"""WITH {HOURLY}, {SIGNED}
    SELECT symbol, "timestamp", step + coalesce(lag(step) OVER ({W}), 0) AS "OBV" FROM signed""",
    "enrich_all": f"{ENRICHED}\nSELECT * FROM enriched",
    "latest_sma": f"""WITH {DAILY}, newest AS (
        SELECT * FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY "timestamp" DESC) <= 20)
    SELECT symbol, {six('CASE WHEN count(*) = 20 THEN avg(close) END', '"SMA_20"')}
    FROM newest GROUP BY symbol""",
    "latest_ema": f"""WITH RECURSIVE {DAILY}, {_numbered('bars', 'close', '"timestamp"')}, {EMA_RECURSION}
    SELECT symbol, {six('arg_max(ema, rn)', '"EMA_12"')} FROM walk GROUP BY symbol""",
    "unpivot_indicators": UNPIVOTED,
    "to_indicator_records": _records(),
    "indicator_parameters": f"""WITH {HOURLY}, settings AS (
        SELECT * FROM (VALUES {", ".join(str(p) for p in PARAMETERS)}) v(indicator_type, name, setting))
    SELECT symbol, "timestamp", date_bucket, indicator_type, name,
           CAST(setting AS DOUBLE) AS parameter
    FROM bars, settings""",
    "group_indicator_maps": _records(),
    "read_indicator_value": f"""{ENRICHED}
    SELECT symbol, "timestamp", bollinger_upper AS "BOLLINGER_upper",
           "MACD_Signal" AS "MACD_signal", CAST("OBV" AS DOUBLE) AS "OBV_value"
    FROM enriched""",
    "returns": f"""WITH {DAILY}, {CHANGE}
    SELECT symbol, "timestamp", {six('simple_return', 'simple_return')},
           {six('log_return', 'log_return')}
    FROM change""",
    "correlation_matrix": _correlations(),
    "covariance_matrix": f"""WITH {DAILY}, {CHANGE}
    SELECT a.symbol AS symbol_a, b.symbol AS symbol_b,
           {six('avg(a.log_return)', 'mean_a')}, {six('avg(b.log_return)', 'mean_b')},
           {six('covar_samp(a.log_return, b.log_return)', 'covariance')}, count(*) AS n
    FROM change a JOIN change b ON a."timestamp" = b."timestamp" AND a.symbol <= b.symbol
    WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL
    GROUP BY a.symbol, b.symbol""",
    "stored_correlations": _correlations(),
    "stored_covariances": f"""WITH {DAILY}, {CHANGE}
    SELECT a.symbol AS symbol_a, b.symbol AS symbol_b,
           {six('avg(a.log_return)', 'mean_a')}, {six('avg(b.log_return)', 'mean_b')},
           {six('covar_samp(a.log_return, b.log_return)', 'covariance')}, count(*) AS n
    FROM change a JOIN change b ON a."timestamp" = b."timestamp" AND a.symbol <= b.symbol
    WHERE a.log_return IS NOT NULL AND b.log_return IS NOT NULL
    GROUP BY a.symbol, b.symbol""",
    "historical_var_es": f"""WITH {DAILY}, {CHANGE}, tails AS (
        SELECT symbol, count(simple_return) AS n,
               quantile_cont(simple_return, 0.05) AS value_at_risk
        FROM change WHERE simple_return IS NOT NULL GROUP BY symbol)
    SELECT t.symbol, any_value(t.n) AS n, {six('any_value(t.value_at_risk)', 'value_at_risk')},
           {six('avg(c.simple_return)', 'expected_shortfall')}
    FROM tails t JOIN change c ON c.symbol = t.symbol AND c.simple_return <= t.value_at_risk
    GROUP BY t.symbol""",
    "stored_var_es": f"""WITH {DAILY}, {CHANGE}, held AS (
        SELECT * FROM change WHERE simple_return IS NOT NULL
          AND "timestamp" >= TIMESTAMP '1995-07-01' AND "timestamp" < TIMESTAMP '1997-07-01'),
    tails AS (SELECT symbol, count(*) AS n, quantile_cont(simple_return, 0.05) AS value_at_risk FROM held GROUP BY symbol)
    SELECT t.symbol, any_value(t.n) AS n, {six('any_value(t.value_at_risk)', 'value_at_risk')},
           {six('avg(c.simple_return)', 'expected_shortfall')}
    FROM tails t JOIN held c ON c.symbol = t.symbol AND c.simple_return <= t.value_at_risk
    GROUP BY t.symbol""",
    "scenario_impact": f"""WITH shocks AS (
        SELECT * FROM (VALUES {SHOCK_ROWS}) v(scenario, symbol, shock))
    SELECT o_custkey AS portfolio, s.scenario, {six('sum(o_totalprice * coalesce(shock, 0))', 'impact')},
           {six('sum(o_totalprice)', 'exposure')}
    FROM orders CROSS JOIN (SELECT DISTINCT scenario FROM shocks) s
    LEFT JOIN shocks k ON o_orderpriority = symbol AND k.scenario = s.scenario
    GROUP BY o_custkey, s.scenario""",
    "lag_features": f"""WITH {DAILY}, {CHANGES}, {FEATURES}
    SELECT symbol, "timestamp", {six('close', 'close')},
           {six(f'lag(sma, 1) OVER ({W})', '"SMA_5_lag_1"')},
           {six(f'lag(sma, 2) OVER ({W})', '"SMA_5_lag_2"')},
           {six(f'lag(rsi, 1) OVER ({W})', '"RSI_14_lag_1"')},
           {six(f'lag(rsi, 2) OVER ({W})', '"RSI_14_lag_2"')},
           {six(f'lead(close) OVER ({W})', 'next_close')}
    FROM features""",
    "forecast_metrics": f"""WITH {DAILY}, forecasts AS (
        SELECT symbol, avg(close) OVER {last(5)} AS predicted, lead(close) OVER ({W}) AS actual
        FROM bars)
    SELECT symbol, {six('sqrt(avg((predicted - actual) ** 2))', 'rmse')},
           {six('avg(abs((predicted - actual) / actual)) * 100', 'mape')}, count(*) AS n
    FROM forecasts WHERE actual IS NOT NULL GROUP BY symbol""",
    "walk_forward": f"""WITH {DAILY}, rows AS (
        SELECT symbol, "timestamp", avg(close) OVER {last(5)} AS x, lead(close) OVER ({W}) AS y,
               epoch_us("timestamp") - epoch_us(TIMESTAMP '1995-01-01') AS since,
               epoch_us(lead("timestamp") OVER ({W})) - epoch_us(TIMESTAMP '1995-01-01') AS known
        FROM bars),
    folds AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS fold, 182 * 86400000000 AS width),
    lines AS (
        SELECT fold, symbol, regr_slope(y, x) AS slope, regr_intercept(y, x) AS base
        FROM rows, folds
        WHERE since < fold * width AND known + 10 * 86400000000 <= fold * width AND since >= fold * width - 730 * 86400000000
        GROUP BY fold, symbol),
    tested AS (
        SELECT f.fold, r.symbol, base + slope * x AS predicted, y AS actual
        FROM rows r JOIN folds f ON since >= f.fold * width AND since < (f.fold + 1) * width
        JOIN lines l ON l.fold = f.fold AND l.symbol = r.symbol)
    SELECT fold, symbol, {six('sqrt(avg((predicted - actual) ** 2))', 'rmse')},
           {six('avg(abs((predicted - actual) / actual)) * 100', 'mape')}, count(*) AS n
    FROM tested WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY fold, symbol""",
    "sentiment_evolution": f"""WITH {SCORES}
    SELECT symbol, "timestamp", event_id, {six('sentiment_score', 'sentiment_score')},
           {_age(86400, 'evolution_24h')}, {_age(604800, 'evolution_7d')}
    FROM scores""",
    "daily_sentiment": _daily_sentiment(""),
    "stock_daily_sentiment": _daily_sentiment("symbol, "),
    "daily_keywords": f"""WITH {SCORES}, words AS (
        SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date_bucket,
               unnest([symbol, 'k' || (size % 7)]) AS keyword
        FROM scores)
    SELECT date_bucket, keyword, count(*) AS mentions FROM words GROUP BY date_bucket, keyword""",
    "articles_by_symbol": """WITH articles AS (
        SELECT d.doc_id, source, lang, text,
               TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS "timestamp"
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    named AS (
        SELECT *, unnest(list_distinct([lang, source])) AS symbol FROM articles)
    SELECT symbol, CAST(doc_id AS VARCHAR) AS article_id, "timestamp", source, text AS content
    FROM named WHERE symbol IN ('en', 'fr') AND "timestamp" >= TIMESTAMP '2024-01-01 01:00:00'""",
    "article_index": """WITH named AS (
        SELECT *, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS "timestamp",
               unnest(list_distinct([lang, source])) AS symbol FROM documents)
    SELECT symbol, CAST(doc_id AS VARCHAR) AS article_id, "timestamp", source, text AS content
    FROM named WHERE symbol IN ('de', 'src3', 'nobody') AND "timestamp" >= TIMESTAMP '2024-01-01 02:00:00'""",
    "members_over_time": f"""WITH {PARTS},
    yearly AS (
        SELECT p.*, n FROM parts p, (SELECT unnest(range(5)) AS n)
        WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 7 <> n),
    weights AS (
        SELECT p_type, n, sector, sum(p_retailprice) AS price,
               sum(sum(p_retailprice)) OVER (PARTITION BY p_type, n) AS total
        FROM yearly GROUP BY p_type, n, sector),
    members AS (
        SELECT p_type, n, sector, p_brand, count(*) OVER (PARTITION BY p_type, n, sector) AS shared
        FROM (SELECT DISTINCT p_type, n, sector, p_brand FROM yearly)),
    held AS (
        SELECT p_type, n, make_timestamp(1994 + n, 3, 1, 0, 0, 0) AS valid_from,
               lead(make_timestamp(1994 + n, 3, 1, 0, 0, 0)) OVER (PARTITION BY p_type ORDER BY n) AS valid_to
        FROM (SELECT DISTINCT p_type, n FROM yearly)),
    asked AS (
        SELECT p_type, unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '1998-07-01', INTERVAL 2 MONTHS)) AS t
        FROM (SELECT DISTINCT p_type FROM yearly))
    SELECT a.p_type AS index_symbol, a.t AS "timestamp", m.p_brand AS company_symbol, m.sector,
           {six('w.price / w.total / m.shared', 'weight')}, h.valid_from
    FROM asked a JOIN held h ON h.p_type = a.p_type AND a.t >= h.valid_from AND (h.valid_to IS NULL OR a.t < h.valid_to)
    JOIN members m ON m.p_type = h.p_type AND m.n = h.n
    JOIN weights w ON w.p_type = m.p_type AND w.n = m.n AND w.sector = m.sector""",
    "index_composition": f"""WITH {PARTS},
    weights AS (
        SELECT p_type, sector, sum(p_retailprice) AS price,
               sum(sum(p_retailprice)) OVER (PARTITION BY p_type) AS total
        FROM parts GROUP BY p_type, sector),
    members AS (
        SELECT p_type, sector, p_brand, count(*) OVER (PARTITION BY p_type, sector) AS shared
        FROM (SELECT DISTINCT p_type, sector, p_brand FROM parts)),
    prices AS (SELECT p_brand, avg(p_retailprice) AS price FROM parts GROUP BY p_brand)
    SELECT m.p_type AS index_symbol, m.p_brand AS company_symbol, m.sector,
           {six('w.price / w.total', 'sector_weight')},
           {six('w.price / w.total / m.shared', 'weight')}, {six('p.price', 'price')}
    FROM members m
    JOIN weights w ON w.p_type = m.p_type AND w.sector = m.sector
    JOIN prices p ON p.p_brand = m.p_brand""",
    # The pages use <b> within lines, <p>, <br> and <h1> between them, and the
    # entities amp and quot, sometimes cut short.
    "article_text": r"""WITH bodies AS (
        SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS body
        FROM pages),
    texts AS (
        SELECT page_id, url,
               regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS text
        FROM bodies)
    SELECT page_id, url,
           trim(regexp_replace(
               regexp_replace(replace(text, '&quot;', '"'), '&amp;?', '&', 'g'),
               '\s+', ' ', 'g')) AS article_text
    FROM texts""",
    "checked_payloads": f"""
    SELECT symbol, count(*) AS bars, min(volume) AS least_volume, true AS has_columns
    FROM ({_exploded(ALIGNED)}) GROUP BY symbol""",
    "parameters_by_type": f"""{ENRICHED},
    types(indicator_type, per_bar) AS (VALUES ('SMA', ['SMA_20']), ('BOLLINGER', ['upper', 'middle', 'lower']), ('RSI', ['RSI_14']),
        ('MACD', ['line', 'signal', 'histogram']), ('EMA', ['EMA_12']), ('STOCHASTIC', ['k', 'd']), ('OBV', ['OBV'])),
    given(indicator_type, parameter, value) AS (VALUES ('SMA', 'period', 20.0::DOUBLE), ('BOLLINGER', 'period', 20.0::DOUBLE),
        ('BOLLINGER', 'stddev', 2.0::DOUBLE), ('RSI', 'period', 14.0::DOUBLE), ('MACD', 'fast', 12.0::DOUBLE), ('MACD', 'slow', 26.0::DOUBLE),
        ('MACD', 'signal', 9.0::DOUBLE), ('EMA', 'period', 12.0::DOUBLE), ('EMA', 'smoothing', 2.0::DOUBLE),
        ('STOCHASTIC', 'k', 14.0::DOUBLE), ('STOCHASTIC', 'd', 3.0::DOUBLE))
    SELECT t.indicator_type, symbol, n * len(per_bar) AS n, parameter, value
    FROM types t CROSS JOIN (SELECT symbol, count(*) AS n FROM enriched GROUP BY symbol)
    LEFT JOIN given g ON g.indicator_type = t.indicator_type""",
    "stream_bars": f"""WITH {STREAMED}
    SELECT symbol, date_bucket, "timestamp", {bar_columns()} FROM closed""",
    "stream_indicators": f"""WITH RECURSIVE {STREAMED}, {SIGNED},
    {_numbered('closed', 'close', '"timestamp"')}, {EMA_RECURSION}
    SELECT n.symbol, n."timestamp", {six('w.ema', '"EMA_12"')}, o."OBV"
    FROM numbered n
    JOIN walk w ON w.symbol = n.symbol AND w.rn = n.rn
    JOIN (SELECT symbol, "timestamp", {OBV} AS "OBV" FROM signed) o
      ON o.symbol = n.symbol AND o."timestamp" = n."timestamp\"""",
}
