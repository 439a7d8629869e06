"""Line dedup and the URL filter against plain Python and their SQL."""

import hashlib
import random
import string
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from awkward import awkward_docs, awkward_texts, docs_of, empty_docs
from pyspark.sql import functions as F

from storewake.llm import line_dedup, url_filter
from storewake.llm.common import work_folder
from storewake.llm.queries import BLOCKED_HOSTS, ORACLES, QUERIES, RULES

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_lines(rows, min_docs, min_chars=1):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    counts = Counter(k for _, lines in texts for k in {key(x) for x in lines})
    out = []
    for i, lines in texts:
        kept = [x for x in lines if not (len(key(x)) >= min_chars and counts[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def line_rows():
    r = random.Random(4)
    lines = ["Terms of Use", " terms of use\t", "TERMS OF USE", "É", "é", "", "  ", "a", "unique {}"]
    rows = [(i, "\n".join(r.choices(lines, k=5)).replace("{}", str(i))) for i in range(60)]
    return rows + awkward_texts()


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("min_chars", [1, 2])
def test_lines_in_batches(spark, broadcast_rows, min_chars):
    rows = line_rows()
    parts = [docs_of(spark, rows[i::7]) for i in range(7)]
    out = line_dedup.without_shared_lines(
        parts, min_docs=4, min_chars=min_chars, fanout=2, broadcast_rows=broadcast_rows
    ).collect()
    made = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out)
    assert made == plain_lines(rows, 4, min_chars)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for n in range(7):
        runs.add(spark.createDataFrame([(bytes([n % 2]), 1), (bytes([9]), 1)], "key binary, n bigint"))
    assert len(runs.paths) <= 4
    assert sorted(bytes(r.key) for r in runs.frequent().collect()) == [b"\x00", b"\x01", b"\x09"]


def test_lines_of_an_empty_table(spark):
    assert line_dedup.without_shared_lines([empty_docs(spark)]).count() == 0


def connection(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    cursor = connection(sf_dir).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(row[c] for c in columns) for row in frame.collect()) == wanted


URLS = [
    "http://WWW.Example.com/en/x?q#f",
    "https://example.com/en/",
    "https://example.com/en",
    "https://a.b.example.com/en/1",
    "https://notexample.com/en/1",
    "https://com/",
    "https://com",
    "x://net/es/",
    "x://deep.net/fr/?a",
    "x://net/FR/",
    "https://blog.cheap-pills.example.net/en/10",
    "https://cheap-pills.example.net",
    "https://xcheap-pills.example.net/",
    "https://free-bets.example.net/es/1",
    "www.example.com/en/",
    "a://b://c.com/d",
    "://",
    "http:///en/",
    "http://example.com:80/en/",
    "http://ÄPFEL.COM/Pfad",
    "http://.com/",
    "http://" + "a." * 5000 + "com/" + "p" * 5000,
    "",
    None,
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(LOWER), rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    inside = lambda name: host == name or host.endswith("." + name)
    fits = [r for r in RULES if inside(r.host) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.key))
        return host, path, best.key, best.verdict
    return host, path, None, "block" if any(inside(h) for h in BLOCKED_HOSTS) else "allow"


def test_urls(spark):
    rows = [(i, u, "h", "k") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "k")] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, keys string")
    out = url_filter.judged(pages, RULES, BLOCKED_HOSTS).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out) == Counter(
        (i, *plain_verdict(u)) for i, u, *_ in rows
    )
    assert url_filter.judged(pages.limit(0), RULES, BLOCKED_HOSTS).count() == 0
    none = url_filter.judged(pages, [], []).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}


def test_cascade_is_exact_over_its_universe(spark):
    hashed = lambda f: f.select(F.xxhash64("id", F.lit(1)).alias("h1"), F.xxhash64("id", F.lit(2)).alias("h2"))
    universe, listed = spark.range(30_000), spark.range(0, 30_000, 13)
    cascade = url_filter.build_cascade(hashed(listed), hashed(universe), work_folder(spark))
    assert len(cascade.levels) > 2
    rows = hashed(universe).withColumn("id", F.monotonically_increasing_id()).toPandas()
    keys = universe.select("id", F.xxhash64("id", F.lit(1)).alias("h1"), F.xxhash64("id", F.lit(2)).alias("h2")).toPandas()
    found = cascade.has(keys["h1"].to_numpy(), keys["h2"].to_numpy())
    assert np.array_equal(found, keys["id"].to_numpy() % 13 == 0)
    assert len(rows) == 30_000
    with pytest.raises(ValueError):
        url_filter.build_cascade(hashed(listed), hashed(universe), work_folder(spark), max_bits=64)


def test_awkward_lines_alone(spark):
    out = line_dedup.without_shared_lines([awkward_docs(spark)]).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == plain_lines(
        awkward_texts(), 10
    )
