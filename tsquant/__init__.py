"""Market time series on Spark: bars, cleansing, indicators, risk, news."""
