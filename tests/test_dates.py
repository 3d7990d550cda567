"""Dates are read by what they look like, so that no text costs an exception."""

import datetime

from pyspark.sql import functions as F

from tallyframe.functions.cells import leading_date
from tallyframe.functions.dates import FORMATS, _shape, parse_date

READ = {
    "5-Mar-2024": "2024-03-05", "5-March-2024": "2024-03-05", "5-mar-24": "2024-03-05", "5-March-24": None, "5 May 2024": "2024-05-05", "5 May, 2024": "2024-05-05", "5 Mar, 2024": None, "Mar 5, 2024": "2024-03-05", "March 5,2024": "2024-03-05", "Mar. 5, 2024": None,
    "31/12/2024": "2024-12-31", "12/31/99": "2099-12-31", "2024/3/5": "2024-03-05", "2024.3.5": "2024-03-05", "15.3.2024": "2024-03-15", "15.3.24": None, "30-2-2024": None, "13-12-2024": "2024-12-13", "2024-13-1": None, "1//2/2024": None, "1/2/2024/3": None, "MAR 31,2028 x": None,
}


def test_forms_of_dates(spark):
    frame = spark.createDataFrame([(t,) for t in READ], "t string").withColumn("d", parse_date(F.col("t"))["value"].cast("string"))
    assert {r.t: r.d for r in frame.collect()} == READ


def test_every_format_is_read(spark):
    day = datetime.date(2024, 11, 23)
    said = spark.range(1).select(*[F.date_format(F.lit(day), f).alias(str(n)) for n, f in enumerate(FORMATS)]).first()
    frame = spark.createDataFrame([(t,) for t in said], "t string")
    assert {r[0] for r in frame.select(parse_date(F.col("t"))["value"]).collect()} == {day}
    assert not [f for f, t in zip(FORMATS, said, strict=True) if not frame.where(F.lit(t).rlike(_shape(f))).count()]


def test_no_parser_by_pattern(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(leading_date(F.col("t"))["value"])._jdf.queryExecution().optimizedPlan().toString()
    assert "gettimestamp" not in plan.lower()
