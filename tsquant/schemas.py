"""Row shapes of the tables and payloads the package reads and writes.

Fixed values: names and types of fields are those of the stored tables and of the
chart payload, and must stay as they are.
"""

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

QUOTE_ARRAYS = T.StructType(
    [
        T.StructField("open", T.ArrayType(T.DoubleType())),
        T.StructField("close", T.ArrayType(T.DoubleType())),
        T.StructField("high", T.ArrayType(T.DoubleType())),
        T.StructField("low", T.ArrayType(T.DoubleType())),
        T.StructField("volume", T.ArrayType(T.LongType())),
    ]
)

CHART_META = T.StructType(
    [
        T.StructField("currency", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchangeName", T.StringType()),
        T.StructField("fullExchangeName", T.StringType()),
        T.StructField("regularMarketPrice", T.DoubleType()),
        T.StructField("previousClose", T.DoubleType()),
        T.StructField("dataGranularity", T.StringType()),
        T.StructField("range", T.StringType()),
    ]
)

CHART_RESULT = T.StructType(
    [
        T.StructField("meta", CHART_META),
        T.StructField("timestamp", T.ArrayType(T.LongType())),
        T.StructField(
            "indicators",
            T.StructType([T.StructField("quote", T.ArrayType(QUOTE_ARRAYS))]),
        ),
    ]
)

# One document per symbol: chart.result[0] holds epoch seconds and parallel arrays.
CHART = T.StructType(
    [
        T.StructField(
            "chart",
            T.StructType(
                [
                    T.StructField("result", T.ArrayType(CHART_RESULT)),
                    T.StructField("error", T.StringType()),
                ]
            ),
        ),
        T.StructField(CORRUPT, T.StringType()),
    ]
)

BAR = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("open", T.DoubleType(), False),
        T.StructField("high", T.DoubleType(), False),
        T.StructField("low", T.DoubleType(), False),
        T.StructField("close", T.DoubleType(), False),
        T.StructField("volume", T.LongType(), False),
    ]
)

BARS_TABLE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date_bucket", T.StringType()),  # yyyy-MM
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

QUOTE = T.StructType(
    [
        T.StructField("Symbol", T.StringType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Timestamp", T.TimestampType()),
    ]
)

INDICATOR_RECORD = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date_bucket", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("indicator_type", T.StringType()),
        T.StructField("values", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("parameters", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
