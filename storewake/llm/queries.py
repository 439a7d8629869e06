"""The registered queries of the corpus operators, with their SQL oracles where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.llm import (
    conversation_repair,
    decontamination,
    exact_dedup,
    line_dedup,
    lm_scoring,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    secrets,
    sharding,
    spans,
    toxicity,
    url_filter,
)
from storewake.llm.common import land, table, work_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return keep


#: The rules of the contract. A url without a rule is judged by the listed hosts.
RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
BLOCKED_HOSTS = (
    "adult-x.example.com",
    "ads-track.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)
LINE_BATCHES = 4


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text after restoring disguised words."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query(r"""
    with lines as (
      select row, doc_id, pos, line, translate(
          trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from (
        select row, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos
        from (select row_number() over () as row, doc_id,
            string_split(coalesce(text, ''), chr(10)) as parts from documents))),
    frequent as (
      select key from lines where length(key) >= 1 group by key having count(distinct row) >= 10)
    select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by pos) filter (f.key is null), '')) as kept_sha256
    from lines l left join frequent f on l.key = f.key
    group by row, doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more have."""
    docs = table(spark, sf_dir, "documents")
    batches = line_dedup.file_batches(spark, docs, LINE_BATCHES)
    return line_dedup.without_shared_lines(batches).select(
        "doc_id", "n_lines", "n_dropped", "kept_sha256"
    )


@query("""
    with parts as (
      select page_id, translate(regexp_extract(rest, '^[^/?#]*'),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
      from (select page_id, case when instr(url, '://') > 0
          then substr(url, instr(url, '://') + 3) else '' end as rest from pages)),
    rules(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
      ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    listed(h) as (values ('adult-x.example.com'), ('ads-track.example.com'),
      ('casino-win.example.net'), ('cheap-pills.example.net'), ('free-bets.example.net'),
      ('spam-farm.example.org'))
    select page_id, host, path,
      (select h || p from rules r where (host = h or ends_with(host, '.' || h))
        and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
      coalesce(
        (select verdict from rules r where (host = h or ends_with(host, '.' || h))
          and starts_with(path, p) order by length(h || p) desc limit 1),
        case when exists (select 1 from listed where host = h or ends_with(host, '.' || h))
          then 'block' else 'allow' end) as verdict
    from parts
""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on urls by rules, and by listed hosts where no rule fits."""
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, edited copies too."""
    return decontamination.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


@query(r"""
    with t as (
      select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h
      from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
      row_number() over (partition by h order by doc_id) = 1 as kept, h as text_sha256
    from t window w as (partition by h)
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies after folding white space; the smallest id of each group stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards by the weighted hash tree, and the place in a fleet with one more."""
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


@query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents, with their links."""
    return near_dedup.similar_groups(table(spark, sf_dir, "documents")).drop("text_hash")


@query()
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data by pattern, with the terms that disclose it."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(spans.listing(F.col("base")), 256).alias("base_sha256"),
        spans.listing(spans.in_order(F.col("found"), ("rank", "start"))).alias("spans"),
    )


@query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern, with weak parts that complement each other."""
    found = secrets.found_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(spans.listing(F.col("base")), 256).alias("base_sha256"),
        spans.listing(F.col("found")).alias("spans"),
    )


@query()
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every whole text under a bigram model learnt from four fifths of them."""
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after planted damage."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.reports(rows, marker=F.col("gone"))


@query()
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that share their first turns with the first of their hundred."""
    numbered = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"))
    turns = prefix_trie.rebuilt_turns(land(numbered, f"{work_folder(spark)}/turns"))
    return prefix_trie.prefix_trie(turns).drop("node")
