"""Queries over the settings of a shop fleet; every customer stands for a shop."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.common import Catalog
from registry.sample import landed, run_sql, view, with_views
from storewake.operators import settings_jobs as jobs
from storewake.sources import settings as settings_source
from storewake.sources import webhooks
from storewake.sources.settings import SETTING_TYPES, theme_blocks, wide_settings

catalog = Catalog()
query = catalog.query

FLEET = """
select c_custkey as n, 'store' || cast(c_custkey as string) || '.myshopify.com' as shop,
  case c_custkey % 5 when 0 then null when 1 then ' phc_abc ' when 2 then 'bad_key'
    else 'phc_' || cast(c_custkey as string) end as api_key,
  case c_custkey % 4 when 0 then null when 1 then 'not a url' else 'https://eu.example.com' end as api_host,
  case c_custkey % 6 when 0 then null when 1 then 'bogus' when 2 then 'anonymized'
    when 3 then 'non-anonymized' else 'non-anonymized-by-consent' end as data_collection_strategy,
  case c_custkey % 7 when 0 then null when 1 then '[]' else '["page_viewed","clicked"]' end as tracked_events,
  case c_custkey % 3 when 1 then 'true' when 2 then 'false' end as ecommerce_spec,
  case c_custkey % 8 when 0 then 'false' when 1 then null else 'true' end as web_pixel_feature_toggle,
  case when c_custkey % 9 <> 0 then case when c_custkey % 2 = 0 then 'true' else 'false' end end as server_side_feature_toggle,
  case when c_custkey % 10 <> 0 then '{{"page_viewed":false,"clicked":' ||
    case when c_custkey % 2 = 0 then 'true' else 'false' end || ',"cart_viewed":false}}' end as web_pixel_events_settings,
  case when c_custkey % 11 <> 0 then 'true' end as js_web_feature_toggle,
  case c_custkey % 6 when 0 then null when 1 then '{{"persistence":"disk","capture_pageview":"yes"}}'
    when 2 then '{{"session_idle_timeout_seconds":60,"enable_heatmaps":null,"property_denylist":["a"]}}'
    when 3 then '{{"feature_flag_request_timeout_ms":"3000","ui_host":null,"custom_campaign_params":[1]}}'
    when 4 then '{{"ui_host":"https://elsewhere.example.com","person_profiles":"always","mask_all_text":null}}'
    else '{{}}' end as js_web_config,
  case when c_custkey % 3 = 0 then null when c_custkey % 33 = 1 then ''
    else 'pixel' || cast(c_custkey as string) end as pixel_id,
  case when c_custkey % 3 <> 0 then '["cart_viewed","clicked"]' end as live_tracked
from {customer}
"""
_FLEET = view("fx_fleet", FLEET)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "fleet", lambda s, d: run_sql(s, d, FLEET))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.col(k).alias("value"))
        for k, t in SETTING_TYPES.items()
    ]
    flat = _flat(spark, sf_dir).select("shop", F.inline(F.array(*rows)))
    return flat.where(F.col("value").isNotNull())


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_settings(_settings(spark, sf_dir))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_DEFAULTS = jobs.seed_defaults()


@query(
    with_views(
        "select shop, key, value, true as seeded from fx_fleet, (values "
        + ", ".join(f"({_text(k)}, {_text(v)})" for k, v in _DEFAULTS.items())
        + ") d(key, value) where case key "
        + " ".join(f"when '{k}' then {k}" for k in _DEFAULTS)
        + " end is null union all "
        + " union all ".join(
            f"select shop, '{k}', {k}, false from fx_fleet where {k} is not null" for k in SETTING_TYPES
        ),
        _FLEET,
    )
)
def seed_settings(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    stored = _settings(spark, sf_dir)
    seeded = jobs.seed_settings(flat.select("shop"), stored)
    old = stored.select("shop", "key", F.lit(False).alias("seeded"))
    return seeded.join(old.hint("merge"), ["shop", "key"], "left").select(
        "shop", "key", "value", F.coalesce("seeded", F.lit(True)).alias("seeded")
    )


@query(
    with_views(
        """
select shop, nullif(api_key, '') as api_key, api_host,
  coalesce(data_collection_strategy, 'anonymized') as strategy,
  coalesce(server_side_feature_toggle = 'true', false) as server_enabled
from fx_fleet
""",
        _FLEET,
    )
)
def installed_shops(spark, sf_dir):
    """Shop rows as written by an installation, from the pivoted settings."""
    return jobs.shops_from_settings(_wide(spark, sf_dir))


# Saved forms: even shops save twice; numbers past the fleet are new shops.
_CHANGES = """
select shop, n, seq, case when seq = 2 then '' else 'phc_new' || cast(n as string) end as api_key,
  case when n % 3 = 0 then '' else 'https://new.example.com' end as api_host,
  case when n % 4 = 0 then 'bogus' else 'non-anonymized' end as strategy,
  case n % 5 when 0 then 'true' when 1 then '"true"' when 2 then null else 'false' end as server_enabled
from (select case when n % 10 = 0 then 'new' || shop else shop end as shop, n, 1 as seq from fx_fleet where n % 2 = 0
  union all select shop, n, 2 as seq from fx_fleet where n % 4 = 0 and n % 10 <> 0) c
"""


@query(
    with_views(
        f"""
select shop, nullif(api_key, '') as api_key, nullif(api_host, '') as api_host,
  case when strategy = 'bogus' then 'anonymized' else strategy end as strategy,
  coalesce(server_enabled = 'true', false) as server_enabled
from ({_CHANGES}) qualify row_number() over (partition by shop order by seq desc) = 1
union all
select shop, api_key, api_host, coalesce(data_collection_strategy, 'anonymized'),
  coalesce(server_side_feature_toggle = 'true', false)
from fx_fleet where n % 2 <> 0 or n % 10 = 0
""",
        _FLEET,
    )
)
def upsert_shops(spark, sf_dir):
    shops = jobs.shops_from_settings(_wide(spark, sf_dir))
    fleet = _flat(spark, sf_dir)
    changes = spark.sql(_CHANGES.replace("fx_fleet", "{fleet}"), fleet=fleet)
    return jobs.upsert_shops(shops, changes.withColumnRenamed("seq", "change_seq"))


_BAD = """concat_ws(',', case when coalesce(not starts_with(trim(api_key), 'phc_'), true) then 'api_key' end,
  case when api_host = 'not a url' then 'api_host' end,
  case when data_collection_strategy = 'bogus' then 'data_collection_strategy' end,
  case when tracked_events is null then 'tracked_events' end)"""


@query(with_views(f"select shop, {_BAD} as bad_keys, {_BAD} = '' as good from fx_fleet", _FLEET))
def validate_settings(spark, sf_dir):
    checked = jobs.validated_settings(_wide(spark, sf_dir))
    good = jobs.good_settings(checked).select("shop", F.lit("").alias("bad_keys"), F.lit(True).alias("good"))
    bad = jobs.rejected_settings(checked).select(
        "shop", F.array_join("bad_keys", ",").alias("bad_keys"), F.lit(False).alias("good")
    )
    return good.unionByName(bad)


@query(
    with_views(
        f"""
select shop, trim(api_key) as api_key, coalesce(api_host, '') as api_host,
  coalesce(data_collection_strategy, 'anonymized') as data_collection_strategy,
  tracked_events, case when ecommerce_spec = 'true' then 'true' else 'false' end as ecommerce_spec
from fx_fleet where {_BAD} = ''
""",
        _FLEET,
    )
)
def stringify_settings(spark, sf_dir):
    checked = jobs.good_settings(jobs.validated_settings(_wide(spark, sf_dir)))
    return checked.select("shop", "pixel_settings.*")


_DEFAULT_ON = [n for n, on in jobs.EVENT_DEFAULTS.items() if on]
_REST_ON = [n for n in _DEFAULT_ON if n not in ("page_viewed", "cart_viewed")]


@query(
    with_views(
        f"""
select shop, case when n % 10 = 0 then '{','.join(_DEFAULT_ON)}'
  else '{','.join(_REST_ON)}' || case when n % 2 = 0 then ',clicked' else '' end end as tracked
from fx_fleet
""",
        _FLEET,
    )
)
def tracked_from_toggles(spark, sf_dir):
    toggles = jobs.event_toggles(F.col("web_pixel_events_settings"))
    tracked = jobs.tracked_from_toggles(toggles)
    return _wide(spark, sf_dir).select("shop", F.array_join(tracked, ",").alias("tracked"))


@query(
    with_views(
        "select shop, name, coalesce(case name when 'page_viewed' then n % 10 = 0 when 'cart_viewed'"
        " then n % 10 = 0 when 'clicked' then n % 10 <> 0 and n % 2 = 0 end, d) as is_on from fx_fleet, (values "
        + ", ".join(f"('{n}', {str(on).lower()})" for n, on in jobs.EVENT_DEFAULTS.items())
        + ") t(name, d)",
        _FLEET,
    )
)
def event_setting_defaults(spark, sf_dir):
    """Every switch of every shop, stored or by default."""
    toggles = jobs.event_toggles(F.col("web_pixel_events_settings"))
    return _wide(spark, sf_dir).select("shop", F.explode(toggles).alias("name", "is_on"))


_WANTED = f"(web_pixel_feature_toggle = 'true' and {_BAD} = '' and tracked_events <> '[]')"


@query(
    with_views(
        f"""
select shop, case when wanted then case when live then 'update' else 'create' end when live then 'delete' end as action,
  case when wanted then case when live then 'updated' else 'connected' end when live then 'disconnected' end as status,
  case when wanted then trim(api_key) end as api_key
from (select *, coalesce({_WANTED}, false) as wanted, coalesce(pixel_id, '') <> '' as live from fx_fleet)
""",
        _FLEET,
    )
)
def reconcile_pixels(spark, sf_dir):
    pixels = _flat(spark, sf_dir).where(F.col("pixel_id").isNotNull()).select("shop", "pixel_id")
    plan = jobs.reconcile_pixels(_wide(spark, sf_dir), pixels)
    return plan.select("shop", "action", "status", "settings.api_key")


@query(
    with_views(
        "select shop, n % 7 in (0, 1) as all_disabled from fx_fleet",
        _FLEET,
    )
)
def all_disabled(spark, sf_dir):
    return _wide(spark, sf_dir).select(
        "shop", jobs.all_disabled(F.col("tracked_events")).alias("all_disabled")
    )


@query(
    with_views(
        """
select shop, case when n % 7 in (0, 1) then case when n % 3 = 0 then '' else 'cart_viewed,clicked' end
  else 'page_viewed,clicked' || case when n % 3 = 0 then '' else ',cart_viewed' end end as merged,
  n % 7 not in (0, 1) as page_viewed,
  n % 7 not in (0, 1) or n % 3 <> 0 or (n % 10 <> 0 and n % 2 = 0) as clicked,
  n % 3 <> 0 as cart_viewed, false as form_submitted
from fx_fleet
""",
        _FLEET,
    )
)
def merged_tracked_events(spark, sf_dir):
    live = _flat(spark, sf_dir).select(
        "shop", F.col("live_tracked"), F.to_json(F.struct(F.col("live_tracked").alias("tracked_events"))).alias("live")
    )
    merged = jobs.merged_tracked_events(F.col("tracked_events"), F.col("live_tracked"))
    both = _wide(spark, sf_dir).join(live, "shop").withColumn("merged", merged)
    shown = jobs.shown_toggles(F.col("web_pixel_events_settings"), F.col("live"), F.col("merged"))
    names = ("page_viewed", "clicked", "cart_viewed", "form_submitted")
    return both.select("shop", F.array_join("merged", ",").alias("merged"), shown.alias("t")).select(
        "shop", "merged", *[F.col("t")[n].alias(n) for n in names]
    )


_EMBED = "1234-embed"


def _themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two themes per shop; the main one comes second for every fifth shop."""
    content = F.expr(
        "case n % 6 when 0 then '{\"current\": \"DEFAULT\"}' when 1 then '{\"current\": null}'"
        f" when 2 then '{{\"current\": {{\"blocks\": {{\"a\": {{\"type\": \"x/{_EMBED}/y\", \"disabled\": false}}}}}}}}'"
        f" when 3 then '/* saved */ {{current: {{blocks: {{\"a\": {{type: \\'x/{_EMBED}\\', disabled: true}}, \"b\": {{type: \"other\"}}}}}}}}'"
        f" when 4 then '{{\"current\": {{\"blocks\": {{\"a\": {{\"type\": \"other\"}}, \"b\": {{\"type\": \"{_EMBED}\"}}}}}}}}'"
        " else '{\"current\": {\"sections\": {}}}' end"
    )
    other = f'{{"current": {{"blocks": {{"a": {{"type": "{_EMBED}"}}}}}}}}'
    themes = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.when((F.col("n") % 5 == 0) == F.lit(i == 1), "MAIN").otherwise("DEMO").alias("role"),
            )
            for i in (0, 1)
        ]
    )
    rows = _flat(spark, sf_dir).select("shop", "n", F.inline(themes))
    file = F.struct(
        F.lit("config/settings_data.json").alias("filename"),
        F.when(F.col("role") == "MAIN", content).otherwise(F.lit(other)).alias("content"),
    )
    return rows.withColumn("files", F.when(F.col("n") % 13 != 0, F.array(file)))


@query(with_views("select shop, n % 6 in (2, 4) and n % 13 <> 0 as enabled from fx_fleet", _FLEET))
def embed_status(spark, sf_dir):
    return jobs.embed_status(_themes(spark, sf_dir), _EMBED)


@query(
    with_views(
        """
select shop, 'DEMO' as role, n % 13 <> 0 as enabled from fx_fleet
union all select shop, 'MAIN', n % 6 in (2, 4) and n % 13 <> 0 from fx_fleet
""",
        _FLEET,
    )
)
def any_block_enabled(spark, sf_dir):
    """The same question for every theme, main or not."""
    blocks = theme_blocks(F.get("files", F.lit(0))["content"])
    return _themes(spark, sf_dir).select(
        "shop", "role", jobs.any_block_enabled(blocks, _EMBED).alias("enabled")
    )


# One file per theme: five ways that JSON5 may be written, three that it may not, and none.
_BODIES = (
    '// saved\n{"current": {"blocks": {"a": {"type": "%s"}}}}',
    '{"current": /* a } , */ {"blocks": {"a": {"type": "%s", "note": "// no comment"}}}}',
    "{current: {blocks: {'a,}': {type: 'x/%s', note: 'it\\'s, }'}}}}",
    '{"current": {"blocks": {"a": {"type": "%s", "disabled": true,},"b": {"type": "other",},},},}',
    '{"current": {"blocks": {"a": {"type": "%s"}, // last\n /* one */ }}}',
    '{"current": {"blocks": {"a": {"type": "%s"}}',
    "saved by %s",
    '[{"current": "%s"}]',
)


def _written_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = F.array(*[F.lit(body % _EMBED) for body in _BODIES])
    content = F.get(bodies, (F.col("n") % 9).cast("int"))
    file = F.struct(F.lit("config/settings_data.json").alias("filename"), content.alias("content"))
    return _flat(spark, sf_dir).select(
        "shop", F.lit(0).alias("position"), F.lit("MAIN").alias("role"), F.array(file).alias("files")
    )


@query(
    with_views(
        """
select shop, n % 9 in (5, 6, 7) as quarantined, n % 9 in (0, 1, 2, 4) as enabled from fx_fleet
""",
        _FLEET,
    )
)
def theme_quarantine(spark, sf_dir):
    """Themes in JSON5 of all kinds: which are read, and which are kept aside."""
    themes = _written_themes(spark, sf_dir)
    aside = settings_source.theme_quarantine(themes).select("shop", F.lit(True).alias("quarantined"))
    status = jobs.embed_status(themes, _EMBED)
    return status.join(aside, "shop", "left").select(
        "shop", F.coalesce("quarantined", F.lit(False)).alias("quarantined"), "enabled"
    )


@query(
    with_views(
        """
select shop, cast(null as bigint) as session_no, 'shop' as kind from fx_fleet where n % 4 <> 3
union all select shop, n % 3, 'session' from fx_fleet where n % 4 <> 3
""",
        _FLEET,
    )
)
def uninstall_shops(spark, sf_dir):
    """Shops and their sessions without the uninstalled ones, whose notices come twice."""
    fleet = _flat(spark, sf_dir)
    notices = fleet.where("n % 4 = 3").select(
        F.lit(webhooks.UNINSTALL_TOPIC).alias("topic"), "shop", F.explode(F.array(F.lit(0), F.lit(1))).alias("arrival_seq")
    )
    gone = webhooks.uninstalled_shops(notices)
    shops = jobs.without_uninstalled(fleet.select("shop"), gone)
    sessions = jobs.without_uninstalled(fleet.select("shop", (F.col("n") % 3).alias("session_no")), gone)
    return shops.select(
        "shop", F.lit(None).cast("long").alias("session_no"), F.lit("shop").alias("kind")
    ).unionByName(sessions.withColumn("kind", F.lit("session")))


@query(with_views("select shop from fx_fleet where n % 4 <> 3", _FLEET))
def uninstall_anti_join(spark, sf_dir):
    fleet = _flat(spark, sf_dir)
    return jobs.without_uninstalled(fleet.select("shop"), fleet.where("n % 4 = 3"))


@query(
    with_views(
        """
select shop, case n % 6 when 1 then 'capture_pageview,persistence'
  when 3 then 'feature_flag_request_timeout_ms,custom_campaign_params'
  when 4 then 'ui_host,mask_all_text' else '' end as bad_keys
from fx_fleet where js_web_config is not null
""",
        _FLEET,
    )
)
def js_config_validation(spark, sf_dir):
    stored = _wide(spark, sf_dir).where(F.col("js_web_config").isNotNull())
    errors = jobs.script_config_errors(F.col("js_web_config"))
    return stored.select("shop", F.array_join(errors, ",").alias("bad_keys"))


@query(
    with_views(
        """
select topic, count(*) as notices, count(distinct shop) as shops from (
  select shop, case n % 4 when 0 then 'customers/redact' when 1 then 'customers/data_request'
    when 2 then 'shop/redact' else 'app/uninstalled' end as topic from fx_fleet)
where topic <> 'app/uninstalled' group by 1
""",
        _FLEET,
    )
)
def compliance_audit(spark, sf_dir):
    """Compliance notices are kept as they came, and only counted here."""
    topics = [*webhooks.NOTICE_TOPICS, webhooks.UNINSTALL_TOPIC]
    topic = F.element_at(F.array(*[F.lit(t) for t in topics]), (F.col("n") % 4 + 1).cast("int"))
    landed_rows = _flat(spark, sf_dir).select(
        topic.alias("topic"), "shop", F.lit(0).alias("arrival_seq"), F.to_json(F.struct("n")).alias("payload")
    )
    kept = webhooks.notices(landed_rows)
    return kept.groupBy("topic").agg(
        F.count("*").alias("notices"), F.countDistinct("shop").alias("shops")
    )
