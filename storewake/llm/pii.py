"""Personal data by patterns and by information-theoretic sanitisation, in DataFrame operations only.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their
values are the protected entities. A term discloses an entity by
`PMI(term; entity) / IC(entity)`: 1 if the term is only ever seen in texts with
that entity, 0 if it says nothing about it. The score is shrunk by the chance that
term and entity meet in as many texts without having to do with each other, so it
holds for an entity in one text as for one in thousands. Co-occurrence is counted
in whole texts without the mentions themselves. All counts are of distinct texts,
so copies of a text count once. Terms from the threshold on are spans of kind
`term` wherever they occur in a text, and the sanitised text holds `[TERM]` in
their place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storewake.llm import spans
from storewake.llm.common import land, same, sized, work_folder

KINDS = ("email", "ip", "card", "phone")
#: Disclosure from which a term goes.
THRESHOLD = 0.9
TERM = r"\p{L}{4,}"

#: The patterns of the contract. The added `\G` and look-behind parts
#: only spare searches that start within a run and cannot match.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _ip_parts_fit(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def _luhn(number: Column) -> Column:
    """The checksum of a digit string of 13 to 19 digits."""
    size = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), size),
        F.lit(0),
        lambda sum_, i: sum_ + _luhn_digit(F.substring(number, -i, F.lit(1)).cast("int"), i),
    )
    return F.when(size.between(13, 19), total % 10 == 0).otherwise(False)


def _luhn_digit(digit: Column, place: Column) -> Column:
    doubled = digit * 2
    return F.when(place % 2 == 1, digit).otherwise(
        F.when(doubled > 9, doubled - 9).otherwise(doubled)
    )


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind and then start; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(
        spans.matches(text, EMAIL, "email", 0, gate=F.contains(text, F.lit("@"))),
        spans.keep(spans.matches(text, IP, "ip", 1), _ip_parts_fit),
        spans.keep(
            spans.matches(text, CARD, "card", 2, gate=F.regexp_like(text, F.lit("[0-9][\\x20-]?[0-9]"))),
            lambda v: _luhn(spans.digits(v)),
        ),
        spans.keep(
            spans.matches(text, PHONE, "phone", 3, gate=F.contains(text, F.lit("+"))),
            lambda v: F.length(spans.digits(v)).between(9, 15),
        ),
    )


def _entity(span: Column) -> Column:
    value = span["value"]
    plain = F.when(span["kind"].isin("email", "ip"), F.lower(value)).otherwise(spans.digits(value))
    return F.concat_ws(":", span["kind"], plain)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _without(text: Column, found: Column) -> Column:
    """The text without its mentions of entities."""
    return spans.replaced(text, F.transform(found, lambda s: s.withField("kind", F.lit(""))))


def disclosing_terms(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`term` and its highest `disclosure`, from rows of `text` and `found` (base spans).

    Rows of equal text count as one. The threshold is above 0.
    """
    texts = texts.select(F.xxhash64("text").alias("doc"), _without(F.col("text"), F.col("found")).alias("text"), "found")
    heard = texts.where(F.size("found") > 0)
    folder = work_folder(texts.sparkSession)
    mentions = land(
        heard.select("doc", F.explode("found").alias("s")).select("doc", _entity(F.col("s")).alias("entity")).distinct(),
        f"{folder}/mentions",
    )
    said = land(heard.select("doc", F.explode(_terms(F.col("text"))).alias("term")).distinct(), f"{folder}/said")
    # Entities of the same texts have the same terms and count as one, so a text with many
    # entities of its own is read once.
    entities = mentions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_entity"),
        F.bit_xor("doc").alias("one"),
        F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("two"),
    )
    group = ["n_entity", "one", "two"]
    members = mentions.join(sized(entities), "entity").select("doc", *group).distinct()
    pairs = (
        members.join(said, "doc")
        .groupBy(*group, "term")
        .agg(F.count(F.lit(1)).alias("n_both"))
    )
    copies = land(texts.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")), f"{folder}/copies")
    n_all = F.greatest(F.lit(copies.count()), F.col("n_entity") + 1).cast("double")

    def disclosure(n_term: Column) -> Column:
        n_both = F.col("n_both")
        expected = n_term * F.col("n_entity") / n_all
        pmi = F.log(n_both / expected)
        # Chernoff's bound of the chance of as many common texts.
        chance = F.least(F.lit(1.0), F.pow(expected * math.e / n_both, n_both))
        return pmi / F.log(n_all / F.col("n_entity")) * (1 - chance)

    # A term is in no fewer texts than in those with any entity, so pairs that would not
    # disclose even then need no count over all texts.
    near = said.groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = land(
        pairs.join(near, "term").where(disclosure(F.col("n_near")) >= threshold).drop("n_near"),
        f"{folder}/pairs",
    )
    # The copies of a text share its count, so terms merge before the exchange without the texts.
    share = 1 / F.coalesce(F.col("copies"), F.lit(1))
    common = (
        texts.join(sized(copies.where("copies > 1")), "doc", "left")
        .select(share.alias("share"), F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.round(F.sum("share")).alias("n_term"))
    )
    return (
        pairs.join(common, "term")
        .withColumn("disclosure", disclosure(F.col("n_term")))
        .where(F.col("disclosure") >= threshold)
        .groupBy("term")
        .agg(F.max("disclosure").alias("disclosure"))
    )


def personal_data(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Id, `base` (pattern spans), `found` (with the terms' spans) and `sanitised` text per row.

    Null texts are empty. Rows with equal id and text get equal results, one per
    input row; null ids are ids. Other columns are not read.
    """
    folder = work_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumns(
        {"h": F.xxhash64("text"), "found": base_spans(F.col("text"))}
    )
    terms = land(disclosing_terms(rows, threshold), f"{folder}/terms")
    marked = land(
        rows.select("id", "h", F.explode(_terms(F.col("text"))).alias("term"))
        .join(sized(terms.select("term")), "term", "left_semi")
        .groupBy(F.col("id").alias("_id"), F.col("h").alias("_h"))
        .agg(F.sort_array(F.collect_set("term")).alias("terms")),
        f"{folder}/marked",
    )
    pattern = F.concat(
        F.lit(r"(?iU)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})")
    )
    joined = rows.join(
        sized(marked), same(F.col("id"), F.col("_id")) & (F.col("h") == F.col("_h")), "left"
    )
    term_spans = F.when(F.col("terms").isNull(), spans.no_spans()).otherwise(
        spans.matches(F.col("text"), pattern, "term", len(KINDS))
    )
    every = F.concat("found", term_spans)
    return joined.select(
        F.col("id").alias(id_column),
        F.col("found").alias("base"),
        every.alias("found"),
        spans.replaced(F.col("text"), every).alias("sanitised"),
    )
