"""Secrets by patterns and by linking the parts of multipart credentials, in DataFrame operations only.

Patterns find assignments, access key ids and long hexadecimal runs. Besides
them a text holds weak candidates: identifiers (`user=...`), opaque or short
secrets (`key: ...`, mixed runs of letters and digits) and endpoints (URLs,
`host=...`). One of these means little, so it is reported only when
complementary parts lie in its scope: an interval of `SCOPE` code points around
it. A secret needs an identifier or an endpoint; an identifier or an endpoint
needs a secret. Parts may have any length. Parts of a text meet by an interval join on
bins of the scope's length, each by where it starts and where it ends; as a bin
holds a bounded number of ends, so does the join.

An opaque secret may end a sentence, and may have parts between dots, like a web
token, if one of them is opaque by itself and none holds a slash: dotted runs with
slashes are paths and URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.llm import spans
from storewake.llm.common import land, same, sized, work_folder

KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "secret", "endpoint")
SCOPE = 200

#: The patterns of the contract.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

#: Parts that mean something only together.
IDENTIFIER = (
    r"(?<![A-Za-z0-9_])(?i:user(?:_?name|_?id)?|login|account|client_?id|key_?id)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,}+)"""
)
SECRET = (
    r"(?<![A-Za-z0-9_])(?i:pwd|pass|key|auth|credential|private_?key|password|passwd|secret|token|api_?key)"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,}+)"""
)
_OPAQUE_PART = r"(?=[A-Za-z0-9+_=-]{20})(?=[A-Za-z+_=-]*[0-9])(?=[0-9+_=-]*[A-Za-z])"
OPAQUE = (
    r"(?<![A-Za-z0-9+/_=.@-])(?:"
    r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+(?!@|\.[A-Za-z0-9+/_=-])"
    rf"|(?=(?:(?!{_OPAQUE_PART})[A-Za-z0-9+_=-]++\.)*+{_OPAQUE_PART})"
    r"[A-Za-z0-9+_=-]++(?:\.[A-Za-z0-9+_=-]++)++(?![/@]))"
)
ENDPOINT = (
    r"""(?<![A-Za-z])(?i:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]++"""
    r"""|(?<![A-Za-z0-9_])(?i:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{3,}+"""
)


def base_spans(text: Column) -> Column:
    """Spans of the three kinds by start and then kind; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    # A run too short to count never hides one that does, so only long ones are searched for.
    found = F.concat(
        spans.keep(
            spans.matches(text, ASSIGN, "assign", 0, group=1, gate=assigned),
            lambda v: F.length(v) >= 6,
        ),
        spans.matches(text, ACCESS, "access", 1, gate=F.contains(text, F.lit("AKIA"))),
        spans.matches(text, HEX, "hex", 2),
    )
    return spans.in_order(found, ("start", "rank"))


def weak_spans(text: Column) -> Column:
    """Candidates of the three weak kinds."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.concat(
        spans.matches(text, IDENTIFIER, "identifier", 3, gate=assigned),
        spans.matches(text, SECRET, "secret", 4, gate=assigned),
        spans.matches(text, OPAQUE, "secret", 4, gate=F.regexp_like(text, F.lit("[0-9]"))),
        spans.matches(text, ENDPOINT, "endpoint", 5, gate=assigned),
    )


def _role(kind: Column) -> Column:
    """What a span can be within a credential."""
    return (
        F.when(kind.isin("access", "identifier"), F.lit("identifier"))
        .when(kind == "endpoint", F.lit("endpoint"))
        .otherwise(F.lit("secret"))
    )


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in scope.

    `parts` has `id`, `h` and a struct `s` (span); the result has the distinct
    weak spans among them.
    """
    width = F.lit(scope)
    placed = parts.select(
        "id",
        "h",
        "s",
        _role(F.col("s.kind")).alias("role"),
        F.col("s.kind").isin(*WEAK_KINDS).alias("weak"),
    )
    # A part in scope ends within a scope before the start or starts within one after the end, so
    # two bins on either side hold them all, however long the parts are.
    def bins(before: bool, low: Column, high: Column) -> Column:
        places = F.sequence(F.floor(low / width), F.floor(high / width))
        return F.transform(places, lambda b: F.struct(F.lit(before).alias("before"), b.alias("bin")))

    start, end = F.col("s.start"), F.col("s.end")
    reach = placed.where("weak").withColumn(
        "at", F.explode(F.concat(bins(True, start - scope, start - 1), bins(False, end, end + scope - 1)))
    )
    o_start, o_end = F.col("o_start"), F.col("o_end")
    other = placed.select(
        F.col("id").alias("o_id"),
        F.col("h").alias("o_h"),
        F.col("role").alias("o_role"),
        start.alias("o_start"),
        end.alias("o_end"),
    ).withColumn("o_at", F.explode(F.concat(bins(True, o_end - 1, o_end - 1), bins(False, o_start, o_start))))
    complementary = F.when(F.col("role") == "secret", F.col("o_role") != "secret").otherwise(
        F.col("o_role") == "secret"
    )
    apart = (o_start >= end) | (o_end <= start)
    near = (o_start < end + scope) & (o_end > start - scope)
    return (
        reach.join(
            other,
            same(F.col("id"), F.col("o_id"))
            & (F.col("h") == F.col("o_h"))
            & (F.col("at.before") == F.col("o_at.before"))
            & (F.col("at.bin") == F.col("o_at.bin"))
            & complementary
            & apart
            & near,
            "left_semi",
        )
        .select("id", "h", "s")
        .distinct()
    )


def found_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    scope: int = SCOPE,
) -> DataFrame:
    """Id, `base` (pattern spans), `found` (with the linked weak parts) and `redacted` text per row.

    Null texts are empty. Weak parts that overlap a base span are left to it.
    Rows with equal id and text get equal results, one per input row; null ids
    are ids. Other columns are not read.
    """
    folder = work_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumns(
        {"h": F.xxhash64("text"), "base": base_spans(F.col("text"))}
    )
    weak = spans.disjoint(weak_spans(F.col("text")), F.col("base"))
    parts = land(
        rows.select("id", "h", F.concat("base", weak).alias("all"))
        .where(F.size("all") > 1)
        .distinct()
        .select("id", "h", F.explode("all").alias("s"))
        .select("id", "h", F.col("s").withField("value", F.lit("")).alias("s")),
        f"{folder}/parts",
    )
    linked = land(
        linked_parts(parts, scope)
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.collect_list("s").alias("weak")),
        f"{folder}/linked",
    )
    every = spans.in_order(
        F.concat("base", F.coalesce("weak", spans.no_spans())), ("start", "rank", "end")
    )
    return rows.join(
        sized(linked), same(F.col("id"), F.col("_id")) & (F.col("h") == F.col("_h")), "left"
    ).select(
        F.col("id").alias(id_column),
        "base",
        every.alias("found"),
        spans.replaced(F.col("text"), every).alias("redacted"),
    )
