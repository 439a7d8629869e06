"""What the corpus operators share: tables, landed frames, column checks, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.session import shared_folder

#: Ids are broadcast up to this many rows (a few MB); larger sets are joined by shuffle.
BROADCAST_ROWS = 300_000

#: White space of the text rules: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"

_WORD_BYTES = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a frame once in the shared folder and read on from there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if it has at most `max_rows` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8: runs of ASCII letters and digits and of all other code points
    above U+007F. Null has none."""
    if not text:
        return []
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
