"""Theme texts in JSON5."""

import pytest
from pyspark.sql import functions as F

from storewake.sources import settings

READABLE = [
    "{}",
    ' \n{"current": 1}',
    "{'a': 'x, }', \"b\": [1, 2, ], }",
    "/* , */ {a: 1, /* b */ // c\n }",
    '{"a": "// not a comment, }", "b": "\\"/*"}',
    '{"a": "' + "x" * 60_000 + '",}',
]
BROKEN = ["", "null", "[1,]", "5", '{"a": ', "{a b}", '{"a": "open}', "text"]


@pytest.mark.parametrize("text", [*READABLE, *BROKEN, None])
def test_readable(spark, text):
    (row,) = spark.createDataFrame([(text,)], "c string").select(settings.is_readable(F.col("c")).alias("r")).collect()
    assert row.r == (text in READABLE)


def test_texts_stay_as_they_are(spark):
    text = '{"a": "x, }", /* gone */ \'b\': "// y",} // end'
    (row,) = spark.createDataFrame([(text,)], "c string").select(settings.plain_json5(F.col("c")).alias("p")).collect()
    assert row.p == '{"a": "x, }",  \'b\': "// y"} '
