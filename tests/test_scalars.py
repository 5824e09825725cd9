"""Single steps of the indicators as column expressions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tsquant.functions import scalars as C


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(x):
    return F.lit(x).cast("double")


def test_rsi(spark):
    assert value(spark, C.rsi_from_rs(lit(1.0))) == 50.0
    assert value(spark, C.rsi_from_rs(lit(0.0))) == 0.0
    with pytest.raises(PySparkException, match="must not be -1"):
        value(spark, C.rsi_from_rs(lit(-1.0)))
    assert value(spark, C.rsi_from_averages(lit(3.0), lit(1.0))) == 75.0
    assert value(spark, C.rsi_from_averages(lit(0.0), lit(0.0))) == 100.0


def test_macd_and_ema(spark):
    assert value(spark, C.macd_line(lit(5.0), lit(3.5))) == 1.5
    assert value(spark, C.ema_step(lit(10.0), lit(4.0), 3)) == 7.0


def test_stochastic(spark):
    assert value(spark, C.stochastic_k(lit(15.0), lit(10.0), lit(20.0))) == 50.0
    assert value(spark, C.stochastic_k(lit(1.0), lit(1.0), lit(1.0))) == 50.0
    assert value(spark, C.stochastic_k(lit(20.0), lit(10.0), lit(20.0))) == 100.0


@pytest.mark.parametrize("close, total", [(2.0, 110), (1.0, 100), (0.5, 90)])
def test_obv(spark, close, total):
    step = C.obv_step(F.lit(100), lit(close), lit(1.0), F.lit(10).cast("bigint"))
    assert value(spark, step) == total


def test_obv_refuses_negative_volume(spark):
    with pytest.raises(PySparkException, match="must not be negative"):
        value(spark, C.obv_step(F.lit(0), lit(2.0), lit(1.0), F.lit(-1).cast("bigint")))
