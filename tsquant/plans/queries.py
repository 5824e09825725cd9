"""One query per operator over the shared tables.

Doubles are rounded to six places and times shown without a zone, so that two
engines can be compared value by value.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsquant.functions.scalars import obv_step as obv_step_of
from tsquant.functions.series import Series, number_rows, over_blocks
from tsquant.functions.work import work_dir
from tsquant.operators import bars as B
from tsquant.operators import cleansing as V
from tsquant.operators import composition as C
from tsquant.operators import indicators as I
from tsquant.operators import latest as L
from tsquant.operators import model as M
from tsquant.operators import news as N
from tsquant.operators import reshape as R
from tsquant.operators import risk as K
from tsquant.plans import views
from tsquant.plans.comovement import CoMoments
from tsquant.plans.jobs import compute_indicators
from tsquant.plans.risk_table import RiskTable
from tsquant.plans.views import DAILY, HOURLY, TICKS, bars_daily, bars_hourly, table
from tsquant.schemas import CORRUPT
from tsquant.sources import payloads as P
from tsquant.sources import tables as S
from tsquant.sources import upkeep as U
from tsquant.sources.articles import read_article_index, write_article_index
from tsquant.streaming.bars import read_tick_stream, stream_bars
from tsquant.streaming.indicators import output_schema, stream_indicators
from tsquant.streaming.run import drain

Query = Callable[[SparkSession, str], DataFrame]

BAR = ("open", "high", "low", "close", "volume")
MACD = ("EMA_12", "EMA_26", "MACD", "MACD_Signal", "MACD_Histogram")
BOLLINGER = ("bollinger_middle", "bollinger_upper", "bollinger_lower")
PLAIN = {"Stochastic_%K_14": "stochastic_k_14", "Stochastic_%D_14_3": "stochastic_d_14_3"}
ENRICHED = ("SMA_20", *BOLLINGER, "RSI_14", *MACD, *PLAIN, "OBV")
# Each query that shows a time shows it as "timestamp".
AT = ("symbol", "timestamp")
AS_OF = "2001-08-01"


def six(column: Column) -> Column:
    # Adding zero turns a rounded -0.0 into 0.0.
    return F.round(column, 6) + F.lit(0.0)


def show(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in comparable form, under plain names."""
    types = dict(df.dtypes)
    shown = []
    for name in columns or df.columns:
        column = F.col(f"`{name}`")
        if types[name] == "double":
            column = six(column)
        elif types[name] == "timestamp":
            column = column.cast("timestamp_ntz")
        shown.append(column.alias(PLAIN.get(name, name)))
    return df.select(*shown)


def hourly(operator: Callable[..., DataFrame], *columns: str, **settings) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars = bars_hourly(spark, folder)
        return show(operator(bars, series=HOURLY, **settings), *AT, *columns)

    return query


def on_ticks(operator: Callable[..., DataFrame], *columns: str, **settings) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        ticks = views.ticks(spark, folder)
        return show(operator(ticks, price="price", series=TICKS, **settings), *AT, "event_id", *columns)

    return query


def daily(operator: Callable[..., DataFrame], *columns: str, **settings) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars = bars_daily(spark, folder)
        return show(operator(bars, series=DAILY, **settings), *columns)

    return query


# Bars


def bars_from_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return show(bars_hourly(spark, folder))


def resample_bars(spark: SparkSession, folder: str) -> DataFrame:
    return show(B.resample_bars(bars_hourly(spark, folder), "day"))


def resample_bars_month(spark: SparkSession, folder: str) -> DataFrame:
    return show(B.resample_bars(bars_daily(spark, folder), "month"))


def resample_bars_week(spark: SparkSession, folder: str) -> DataFrame:
    return show(B.resample_bars(bars_daily(spark, folder), "week"))


def apply_retention(spark: SparkSession, folder: str) -> DataFrame:
    return show(B.apply_retention(bars_daily(spark, folder), AS_OF), *AT, *BAR)


def latest_bars(spark: SparkSession, folder: str) -> DataFrame:
    return show(L.latest_bars(bars_daily(spark, folder), 5, series=DAILY), *AT, *BAR)


def newest_bars(spark: SparkSession, folder: str) -> DataFrame:
    ordered = Series.of_bars("day", tiebreak=("symbol",))
    return show(L.latest_bars(bars_daily(spark, folder), 25, False, ordered), *AT, *BAR)


# Sources and sinks


def _landed(spark: SparkSession, folder: str) -> DataFrame:
    return P.parse_chart_payloads(views.payloads(spark, folder))


def _work(spark: SparkSession, purpose: str) -> str:
    """A folder for what a query writes; a local session that names none gets one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        spark.conf.set("spark.checkpoint.dir", f"{tempfile.gettempdir()}/tsquant-shared")
    return work_dir(spark, purpose)


def read_chart_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """With symbols that hold a dot or look like a number."""
    landed = _work(spark, "payloads")
    symbol = F.col("requested_symbol")
    symbol = F.when(symbol == "view", "MC.PA").when(symbol == "click", "0700").otherwise(symbol)
    views.payloads(spark, folder).select(symbol.alias("requested_symbol"), "payload").write.partitionBy(
        "requested_symbol"
    ).text(landed)
    read = P.read_chart_payloads(spark, landed)
    first = F.get(F.col("chart.result"), F.lit(0))
    return read.select(
        "requested_symbol",
        F.col(CORRUPT).isNotNull().alias("corrupt"),
        first["meta"]["symbol"].alias("stated_symbol"),
        F.size(first["timestamp"]).cast("bigint").alias("bars"),
        F.get(first["timestamp"], F.lit(0)).alias("first_at"),
    )


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = _work(spark, "bars")
    S.append_table(bars_daily(spark, folder), path)
    stored = S.read_bars(spark, path, ["1-URGENT", "5-LOW"], "1996-03", "1997-02")
    return show(stored, "symbol", "date_bucket", "timestamp", *BAR)


def newest_load(spark: SparkSession, folder: str) -> DataFrame:
    """A month is loaded a second time with other volumes, which then hold."""
    path = _work(spark, "bars")
    bars = bars_daily(spark, folder)
    S.append_table(bars, path, stamp=True)
    again = bars.where(F.col("date_bucket") == "1996-03")
    S.append_table(again.withColumn("volume", F.col("volume") + 100), path, stamp=True)
    stored = S.read_bars(spark, path, None, "1996-01", "1996-06", newest_load=True)
    return show(stored, *AT, "close", "volume")


def upsert_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Three loads: all bars but those of a month; that month and the one before it, which
    changes; the second load again."""
    path = _work(spark, "bars")
    bars = bars_daily(spark, folder)
    U.upsert_table(bars.where("date_bucket <> '1996-03'"), path)
    changed = F.col("volume") + F.when(F.col("date_bucket") == "1996-02", 100).otherwise(0)
    again = bars.where("date_bucket IN ('1996-02', '1996-03')").withColumn("volume", changed)
    for _ in range(2):
        U.upsert_table(again.unionByName(again), path)
    return show(S.read_bars(spark, path), *AT, *BAR)


def trim_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = _work(spark, "bars")
    S.append_table(bars_daily(spark, folder), path)
    U.trim_table(spark, path, AS_OF, days=100)
    return show(S.read_bars(spark, path), *AT, *BAR)


def write_indicators(spark: SparkSession, folder: str) -> DataFrame:
    bars, records = _work(spark, "bars"), _work(spark, "records")
    S.append_table(bars_hourly(spark, folder), bars)
    compute_indicators(spark, bars, records, series=HOURLY)
    stored = S.read_indicators(spark, records, types=["RSI", "MACD", "OBV"])
    return _flat(stored, "values", "value")


def read_quote_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = _work(spark, "quotes")
    bars_daily(spark, folder).select(
        F.col("symbol").alias("Symbol"),
        F.col("close").alias("Price"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("timestamp").alias("Timestamp"),
    ).write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return show(P.read_quote_csv(spark, path).toDF("symbol", "price", "high", "low", "timestamp"))


# Cleansing


def corrupt_report(spark: SparkSession, folder: str) -> DataFrame:
    return show(V.corrupt_report(_landed(spark, folder)))


def drop_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    return V.drop_corrupt(_landed(spark, folder)).select("requested_symbol", F.col("day").cast("string"))


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    parsed = V.drop_corrupt(_landed(spark, folder))
    return V.extract_chart(parsed, F.col("requested_symbol"))


def _shape_of(arrays: DataFrame) -> DataFrame:
    sizes = [F.size(a).cast("bigint").alias(a) for a in V.ARRAYS]
    first = F.get(F.col("timestamps"), F.lit(0)).alias("first_at")
    return arrays.select("company_symbol", first, *sizes)


def extract_chart(spark: SparkSession, folder: str) -> DataFrame:
    return _shape_of(_extracted(spark, folder))


def keep_aligned_arrays(spark: SparkSession, folder: str) -> DataFrame:
    return _shape_of(V.keep_aligned_arrays(_extracted(spark, folder)))


def _exploded(spark: SparkSession, folder: str) -> DataFrame:
    return V.explode_bars(V.keep_aligned_arrays(_extracted(spark, folder)))


def explode_bars(spark: SparkSession, folder: str) -> DataFrame:
    return show(_exploded(spark, folder))


def drop_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    return show(V.drop_null_rows(_exploded(spark, folder)))


def dedup_bars(spark: SparkSession, folder: str) -> DataFrame:
    return show(V.dedup_bars(_exploded(spark, folder)))


def clean_bars(spark: SparkSession, folder: str) -> DataFrame:
    return show(V.clean_bars(_landed(spark, folder), F.col("requested_symbol")))


def checked_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What the checks of schema, time stamps and rows let through, and how many columns they ask for."""
    parsed = V.require_paths(V.drop_corrupt(_landed(spark, folder)))
    arrays = V.require_timestamps(V.extract_chart(parsed, F.col("requested_symbol")))
    rows = V.require_non_negative_volume(V.require_non_empty(V.explode_bars(V.keep_aligned_arrays(arrays))))
    asked = F.lit(V.has_columns(rows, V.BAR_COLUMNS)).alias("has_columns")
    counts = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("volume").alias("least_volume"))
    return counts.select("symbol", "bars", "least_volume", asked)


# Reshape


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    return I.enrich_all(bars_hourly(spark, folder), series=HOURLY)


def unpivot_indicators(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("indicator_name")
    for shown, plain in PLAIN.items():
        name = F.when(name == shown, F.lit(plain)).otherwise(name)
    return show(R.unpivot_indicators(_enriched(spark, folder)).withColumn("indicator_name", name))


def _flat(records: DataFrame, maps: str, value: str) -> DataFrame:
    return show(
        records.select(*AT, "date_bucket", "indicator_type", F.explode(maps).alias("name", value))
    )


def to_indicator_records(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.to_indicator_records(_enriched(spark, folder)), "values", "value")


def indicator_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.to_indicator_records(_enriched(spark, folder)), "parameters", "parameter")


def parameters_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """The parameters that belong to the type of each value of a table."""
    long = R.unpivot_indicators(_enriched(spark, folder))
    types = long.select(R.classify_indicator(F.col("indicator_name")).alias("indicator_type"), "symbol")
    counted = types.groupBy("indicator_type", "symbol").count().select("indicator_type", "symbol", F.col("count").alias("n"))
    given = F.explode_outer(R.indicator_parameters(F.col("indicator_type"))).alias("parameter", "value")
    return show(counted.select("indicator_type", "symbol", "n", given))


def obv_step(spark: SparkSession, folder: str) -> DataFrame:
    """On-balance volume at each bar from its value at the bar before."""
    bars = I.obv(bars_hourly(spark, folder), series=HOURLY)
    held = over_blocks(bars, lambda frames: [{"obv_before": frames.lag(F.col("OBV")), "before": frames.lag(F.col("close"))}], HOURLY, lookback=1)
    step = obv_step_of(F.col("obv_before"), F.col("close"), F.col("before"), F.col("volume"))
    return show(held.select(*AT, step.alias("OBV")).where("OBV IS NOT NULL"))


def group_indicator_maps(spark: SparkSession, folder: str) -> DataFrame:
    long = R.unpivot_indicators(_enriched(spark, folder))
    return _flat(R.add_keys(R.group_indicator_maps(long)), "values", "value")


def read_indicator_value(spark: SparkSession, folder: str) -> DataFrame:
    records = R.to_indicator_records(_enriched(spark, folder))
    wanted = [("BOLLINGER", "upper"), ("MACD", "signal"), ("OBV", "value")]
    return show(R.read_indicator_value(records, wanted))


# Risk and model


def returns(spark: SparkSession, folder: str) -> DataFrame:
    return show(K.returns(bars_daily(spark, folder), series=DAILY), *AT, "simple_return", "log_return")


def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    blocks = K.count_symbol_blocks(table(spark, folder, "orders"), "o_orderpriority")
    matrix = K.correlation_matrix(
        bars_daily(spark, folder), value="log_return", symbol_blocks=blocks
    )
    return show(matrix)


def _taken_in(spark: SparkSession, folder: str) -> tuple[CoMoments, int]:
    """Bars of all years in four loads, the second of them twice."""
    blocks = K.count_symbol_blocks(table(spark, folder, "orders"), "o_orderpriority")
    kept = CoMoments(spark, _work(spark, "co-moments"), value="log_return")
    bars = bars_daily(spark, folder)
    for first, end in (("1990", "1994"), ("1994", "1996-05-17"), ("1994", "1996-05-17"), ("1996-05-17", "1998"), ("1998", "2100")):
        kept.advance(bars.where(F.col("timestamp").between(first, end) & (F.col("timestamp") < end)), blocks)
    return kept, blocks


def stored_correlations(spark: SparkSession, folder: str) -> DataFrame:
    kept, blocks = _taken_in(spark, folder)
    return show(kept.correlations(blocks))


def stored_covariances(spark: SparkSession, folder: str) -> DataFrame:
    kept, blocks = _taken_in(spark, folder)
    return show(kept.covariances(symbol_blocks=blocks))


def covariance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    change = K.returns(bars_daily(spark, folder), series=DAILY)
    blocks = K.count_symbol_blocks(table(spark, folder, "orders"), "o_orderpriority")
    return show(K.covariance_matrix(change, "log_return", symbol_blocks=blocks))


def historical_var_es(spark: SparkSession, folder: str) -> DataFrame:
    return show(K.historical_var_es(K.returns(bars_daily(spark, folder), series=DAILY)))


def stored_var_es(spark: SparkSession, folder: str) -> DataFrame:
    """Two years out of a table that took in all years in two loads, one of them twice."""
    change = K.returns(bars_daily(spark, folder), series=DAILY)
    kept = RiskTable(spark, _work(spark, "risk"))
    early = F.col("timestamp") < "1996-08-09"
    for part in (change.where(early), change.where(~early), change.where(~early)):
        kept.advance(part)
    return show(kept.var_es("1995-07", "1997-06"))


def scenario_impact(spark: SparkSession, folder: str) -> DataFrame:
    return show(K.scenario_impact(views.positions(spark, folder), views.shocks(spark)))


def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    numbered = number_rows(bars_daily(spark, folder), DAILY)
    bars = I.add_indicators(numbered, [I.sma_indicator(5), I.rsi_indicator(14)], DAILY)
    features = M.lag_features(bars, ["SMA_5", "RSI_14"], (1, 2), series=DAILY)
    lagged = [f"{c}_lag_{n}" for c in ("SMA_5", "RSI_14") for n in (1, 2)]
    return show(features, *AT, "close", *lagged, "next_close")


def forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The 5-row mean as forecast of the next close."""
    bars = I.sma(number_rows(bars_daily(spark, folder), DAILY), 5, series=DAILY)
    features = M.lag_features(bars, ["SMA_5"], (1,), series=DAILY)
    return show(M.forecast_metrics(features, "next_close", "SMA_5"))


def walk_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of a line from the 5-row mean to the next close, by fold of half a year."""
    bars = I.sma(bars_daily(spark, folder), 5, series=DAILY)
    bars = M.label_times(M.lag_features(bars, ["SMA_5"], (1,), series=DAILY), 1, DAILY)
    folds = M.walk_forward(bars, "1995-01-01", "182 days", 6, embargo="10 days", window="730 days")
    forecasts = M.line_forecasts(folds, "SMA_5", "next_close")
    return show(M.forecast_metrics(forecasts, "next_close", "forecast", ("fold", "symbol")))


# News


def sentiment_evolution(spark: SparkSession, folder: str) -> DataFrame:
    aged = N.sentiment_evolution(views.scores(spark, folder), series=TICKS)
    return show(aged, *AT, "event_id", "sentiment_score", "evolution_24h", "evolution_7d")


def _day(df: DataFrame) -> DataFrame:
    return show(df.withColumn("date_bucket", F.col("date_bucket").cast("string")))


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return _day(N.daily_sentiment(views.scores(spark, folder)))


def stock_daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return _day(N.daily_sentiment(views.scores(spark, folder), keys=("symbol",)))


def daily_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _day(N.daily_keywords(views.scores(spark, folder)))


def articles_by_symbol(spark: SparkSession, folder: str) -> DataFrame:
    found = N.articles_by_symbol(
        views.articles(spark, folder), ["en", "fr"], since="2024-01-01 01:00:00", processed=True
    )
    return show(found, "symbol", "article_id", "timestamp", "source", "content")


def article_index(spark: SparkSession, folder: str) -> DataFrame:
    path = _work(spark, "articles")
    write_article_index(views.articles(spark, folder), path, columns=("article_id", "source", "content", "processed"))
    found = read_article_index(spark, path, ["de", "src3", "nobody"], since="2024-01-01 02:00:00")
    return show(found, "symbol", "article_id", "timestamp", "source", "content")


def members_over_time(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of each member of an index at the first instant of every second month."""
    members = C.members_over_time(views.compositions(spark, folder), views.companies(spark, folder))
    months = F.explode(F.sequence(F.lit("1994-01-01").cast("timestamp"), F.lit("1998-07-01").cast("timestamp"), F.expr("INTERVAL 2 MONTHS")))
    asked = members.select("country", "index_symbol").distinct().withColumn("timestamp", months)
    found = C.as_of_intervals(asked, members, ("country", "index_symbol"))
    return show(found, "index_symbol", "timestamp", "company_symbol", "sector", "weight", "valid_from")


def index_composition(spark: SparkSession, folder: str) -> DataFrame:
    members = N.index_composition(views.indices(spark, folder), views.companies(spark, folder))
    priced = members.withColumn("price", F.element_at("indexed_values", "price"))
    return show(
        priced, "index_symbol", "company_symbol", "sector", "sector_weight", "weight", "price"
    )


def article_text(spark: SparkSession, folder: str) -> DataFrame:
    return N.article_text(table(spark, folder, "pages"))


# Streams


def _landing_ticks(spark: SparkSession, folder: str, path: str) -> Iterator[None]:
    """Ticks land week by week, with a tick delivered twice, one far too late, and a
    last one of another symbol that closes the windows before it. The stream is taken up
    after the second week, the third, and the last."""
    ticks = views.ticks(spark, folder)
    week = F.floor((F.dayofmonth("timestamp") - 1) / 8)
    first, last = ticks.agg(F.min("timestamp"), F.max("timestamp")).first()
    for number in range(4):
        part = ticks.where(week == number)
        if number:
            before = ticks.where(week < number)
            again = before.where(F.col("timestamp") == before.agg(F.max("timestamp")).first()[0])
            part = part.unionByName(again)
        if number == 2:
            late = spark.createDataFrame([("view", first, 1e9, 1, -1)], ticks.schema)
            part = part.unionByName(late)
        part.write.mode("append").parquet(path)
        if number in (1, 2):
            yield
    end = spark.createDataFrame([("-", last + timedelta(hours=3), 0.0, 0, -2)], ticks.schema)
    end.write.mode("append").parquet(path)
    yield


def _streamed_bars(spark: SparkSession, folder: str) -> Iterator[DataFrame]:
    """The bars closed after each landing, from one stream that goes on."""
    landed, path, state = _work(spark, "ticks"), _work(spark, "stream-bars"), _work(spark, "stream-state")
    schema = views.ticks(spark, folder).schema
    for _ in _landing_ticks(spark, folder, landed):
        stream = read_tick_stream(spark, landed, schema)
        yield drain(stream_bars(stream, "1 hour", "1 hour", tick_id="event_id"), path, state)


def stream_bars_query(spark: SparkSession, folder: str) -> DataFrame:
    for bars in _streamed_bars(spark, folder):
        closed = bars
    return show(closed)


def stream_indicators_query(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams in a row: closed bars to a table, indicators from that table, both
    taken up again whenever ticks have landed."""
    table, checkpoint = _work(spark, "stream-indicators"), _work(spark, "checkpoint")
    for bars in _streamed_bars(spark, folder):
        path = bars.inputFiles()[0].rsplit("/", 1)[0] if bars.inputFiles() else None
        if path:
            closed = spark.readStream.schema(bars.schema).parquet(path)
            stream_indicators(closed, table, checkpoint).awaitTermination()
    return show(spark.read.schema(output_schema()).parquet(table), *AT, "EMA_12", "OBV")


QUERIES: dict[str, Query] = {
    "bars_from_ticks": bars_from_ticks,
    "resample_bars": resample_bars,
    "resample_bars_week": resample_bars_week,
    "resample_bars_month": resample_bars_month,
    "apply_retention": apply_retention,
    "latest_bars": latest_bars,
    "newest_bars": newest_bars,
    "read_chart_payloads": read_chart_payloads,
    "read_bars": read_bars,
    "newest_load": newest_load,
    "upsert_bars": upsert_bars,
    "trim_bars": trim_bars,
    "write_indicators": write_indicators,
    "read_quote_csv": read_quote_csv,
    "corrupt_report": corrupt_report,
    "drop_corrupt": drop_corrupt,
    "extract_chart": extract_chart,
    "keep_aligned_arrays": keep_aligned_arrays,
    "explode_bars": explode_bars,
    "drop_null_rows": drop_null_rows,
    "dedup_bars": dedup_bars,
    "clean_bars": clean_bars,
    "sma": hourly(I.sma, "SMA_20"),
    "sma_strict": hourly(I.sma, "SMA_20", strict=True),
    "rolling_stddev": hourly(I.rolling_stddev, "SMA_20", "StdDev_20"),
    "rolling_stddev_pop": hourly(I.rolling_stddev, "SMA_20", "StdDev_20", ddof=0),
    "bollinger": hourly(I.bollinger, *BOLLINGER),
    "bollinger_pop": hourly(I.bollinger, *BOLLINGER, ddof=0),
    "ema_one_step": hourly(I.ema_one_step, "EMA_12"),
    "macd_one_step": hourly(I.macd_one_step, *MACD),
    "ema": on_ticks(I.ema, "EMA_12"),
    "macd": on_ticks(I.macd, *MACD),
    "rsi": hourly(I.rsi, "RSI_14"),
    "stochastic": hourly(I.stochastic, *PLAIN),
    "stochastic_strict": hourly(I.stochastic, *PLAIN, strict=True),
    "obv": hourly(I.obv, "OBV"),
    "obv_step": obv_step,
    "obv_two_step": hourly(I.obv_two_step, "OBV"),
    "enrich_all": hourly(I.enrich_all, *ENRICHED),
    "latest_sma": daily(L.latest_sma, "symbol", "SMA_20"),
    "latest_ema": daily(L.latest_ema, "symbol", "EMA_12"),
    "unpivot_indicators": unpivot_indicators,
    "to_indicator_records": to_indicator_records,
    "indicator_parameters": indicator_parameters,
    "parameters_by_type": parameters_by_type,
    "group_indicator_maps": group_indicator_maps,
    "read_indicator_value": read_indicator_value,
    "returns": returns,
    "correlation_matrix": correlation_matrix,
    "covariance_matrix": covariance_matrix,
    "stored_correlations": stored_correlations,
    "stored_covariances": stored_covariances,
    "historical_var_es": historical_var_es,
    "stored_var_es": stored_var_es,
    "scenario_impact": scenario_impact,
    "lag_features": lag_features,
    "forecast_metrics": forecast_metrics,
    "walk_forward": walk_forward,
    "sentiment_evolution": sentiment_evolution,
    "daily_sentiment": daily_sentiment,
    "stock_daily_sentiment": stock_daily_sentiment,
    "daily_keywords": daily_keywords,
    "articles_by_symbol": articles_by_symbol,
    "article_index": article_index,
    "index_composition": index_composition,
    "members_over_time": members_over_time,
    "article_text": article_text,
    "checked_payloads": checked_payloads,
    "stream_bars": stream_bars_query,
    "stream_indicators": stream_indicators_query,
}
