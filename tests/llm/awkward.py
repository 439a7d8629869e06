"""Documents with everything that may go wrong, and helpers of the corpus tests."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("_id", T.StringType()),
        T.StructField("_mark", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


def prose(seed, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghilmnoprstuvy", k=r.randint(3, 8))) for _ in range(words))


def awkward_texts():
    base = prose(1)
    other = prose(2)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base),
        (2, base),  # a copy
        (2, base),  # a repeated row
        (3, base.replace(" ", "\t\n ")),  # equal but for white space
        (4, " ".join(near)),  # a near copy
        (5, None),
        (6, ""),
        (7, " \n "),
        (8, other + "\nShared line of all.\n" + other),
        (None, other),
        (None, None),
        (9, "Ünïcödé ß ǅ 𝄞 \u0085 line\x1cend " * 30),
        (10, prose(3, 30_000)),  # very long
        (11, "a"),
        (12, "x" * 50_000),
        (13, "\n" * 100),
    ]


def docs_of(spark, rows):
    full = [(i, t, "en", "clash", 7, 8, "clash", "clash", "clash") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward_docs(spark):
    return docs_of(spark, awkward_texts())


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
