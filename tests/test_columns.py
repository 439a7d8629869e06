"""Hand-checked values of the column functions."""

import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storewake.functions import ids, urls, values
from storewake.functions.device import device_struct
from storewake.functions.objects import JsonObject
from storewake.operators import page_context, pixel_events, pixel_settings, settings_jobs, shops


def column(spark, texts, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_parse_number(spark):
    texts = ["12.5abc", "  3 ", "-1e2x", ".5", "5.", "abc", "", None, " 7", "1e999", "+4", "--1"]
    expected = [12.5, 3.0, -100.0, 0.5, 5.0, None, None, None, 7.0, None, 4.0, None]
    assert column(spark, texts, values.parse_number) == expected


def test_parse_spend_and_truthy_number(spark):
    assert column(spark, ["", None, "3.5", "x"], values.parse_spend) == [0.0, None, 3.5, None]
    assert column(spark, ["0.00", "", None], values.parse_truthy_number) == [0.0, None, None]


def test_trim_and_missing_values(spark):
    assert column(spark, ["﻿ a ", "\u0085x", None], values.js_trim) == ["a", "\u0085x", None]
    numbers = column(spark, [0.0, float("nan"), 2.0, None], values.number_or_null, "double")
    assert numbers == [None, None, 2.0, None]


def test_join_keeps_places_of_nulls(spark):
    lists = [["a", None, "b"], [], None, [None]]
    assert column(spark, lists, values.joined_or_null, "array<string>") == ["a,,b", None, None, ""]


def test_person_ids(spark):
    texts = [" Guest ", "A@B.com ", "", None, "TRUE", "ok"]
    assert column(spark, texts, ids.is_person_id) == [False, True, False, False, False, True]
    person = lambda c: ids.person_id(c, customer_id=F.lit(7))
    assert column(spark, ["A@B.com ", "null"], person) == ["a@b.com", "shopify_customer_7"]


def test_uuid5_golden(spark):
    made = column(spark, ["abc123token"], lambda c: ids.order_completed_uuid(F.lit("myshop.myshopify.com"), c))
    assert made == ["52b71bac-01e3-561d-8453-7258befe678d"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00")), min_size=1, max_size=20))
def test_uuid5_equals_standard_library(spark, texts):
    namespace = uuid.UUID(ids.EVENT_NAMESPACE)
    assert column(spark, texts, ids.uuid5) == [str(uuid.uuid5(namespace, t)) for t in texts]


def test_event_uuid(spark):
    u = "0cc175b9-c0f1-b6a8-31c3-99e269772661"
    assert column(spark, [u, f"sh-{u}", "bad-id", f"a-b-{u}", None], ids.event_uuid) == [u, u, None, None, None]


def test_time_key_layout(spark):
    (key,) = column(spark, [1_704_067_200_123_456], lambda c: ids.time_key(c, F.lit("a")), "bigint")
    made = uuid.UUID(key)
    assert made.version == 7 and made.variant == uuid.RFC_4122
    assert int(key.replace("-", "")[:12], 16) == 1_704_067_200_123


def test_query_params(spark):
    links = [
        "https://x.com/?utm_source=a%20b+c&utm_source=z",
        "https://x.com/?utm_source=",
        "https://x.com/?a=1#utm_source=q",
        "https://x.com/?utm_source=%zz+",
        "no url",
    ]
    made = column(spark, links, lambda c: urls.campaign_struct(c, "")["utm_source"])
    assert made == ["a b c", "", None, "%zz ", None]


def test_an_address_is_read_once_for_all_its_campaign_parameters(spark):
    links = ["https://x.com/?gclid=1&gclid=2&utm_term=&&_kx=k=v", "https://x.com/", "https://x.com/?", "no url", None]
    rows = spark.createDataFrame([(link,) for link in links], "href string")
    names = list(urls.CAMPAIGN_PARAMS)
    facts = rows.select(urls.campaign_struct(F.col("href"), "").alias("campaign"))
    found = [r.campaign.asDict() for r in facts.collect()]
    none = dict.fromkeys(names)
    assert found == [none | {"gclid": "1", "utm_term": "", "_kx": "k=v"}, none, none, none, none]
    # A text made of the fields, as a page load has three, does not read the address again for each.
    texts = [F.to_json(F.struct(*[F.col("campaign")[n].alias(f"{p}{n}") for n in names])) for p in ("", "initial_")]
    plan = facts.select(*texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_url_parts(spark):
    links = ["https://u:p@h.com:8443/a", "HTTP://H.com:80", "https://h.com:443?x", "ftp//", None]
    assert column(spark, links, urls.url_host) == ["h.com:8443", "h.com", "h.com", None, None]
    assert column(spark, links, urls.url_path) == ["/a", "/", "/", None, None]


def test_referrer_and_engine(spark):
    links = ["https://x.com/?u=google.com", "https://www.bing.com", "", None, "https://h.com:8080/"]
    assert column(spark, links, urls.search_engine) == ["google", "bing", None, None, None]
    assert column(spark, links, urls.referring_domain)[2:] == ["$direct", "$direct", "h.com:8080"]


def test_batch_url_drops_one_slash(spark):
    assert column(spark, ["https://h//", "https://h"], urls.batch_url) == ["https://h//batch/", "https://h/batch/"]


def test_device(spark):
    agents = [
        "Mozilla/5.0 (iPad; CPU OS 16_2 like Mac OS X) AppleWebKit Version/16.2 Mobile Safari/604.1",
        "Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120.0.0.0 Safari/537.36 Edg/120.1",
        "",
    ]
    made = [tuple(r) for r in column(spark, agents, device_struct)]
    assert made[0] == ("iOS", "16.2", "Mobile Safari", "16.2", "tablet")
    assert made[1] == ("Windows", "10.0", "Edge", "120.1", None)
    assert made[2] == (None,) * 5


def test_json_object_overrides_and_absence(spark):
    conditions = {"a": F.col("v") > 1, "b": F.col("v") > 2}

    def make(v):
        o = JsonObject(conditions).put("x", F.lit("base")).put("n", F.lit(None).cast("string"))
        o.put("x", v, when="a").put("y", F.lit(1), when="b").drop("x", when="b")
        return o.put_json("z", F.lit('{"q":1}')).text()

    made = [json.loads(t) for t in column(spark, [1, 2, 3], make, "int")]
    assert made[0] == {"x": "base", "n": None, "z": {"q": 1}}
    assert made[1] == {"x": 2, "n": None, "z": {"q": 1}}
    assert made[2] == {"y": 1, "n": None, "z": {"q": 1}}


def test_feature_flags(spark):
    flags = [{"b": "true", "A": "x\"y", "a": "false"}, {"a": "false"}, {}, None]
    made = column(spark, flags, lambda c: F.concat(F.lit("{"), F.coalesce(page_context.flag_members(c), F.lit("")), F.lit("}")), "map<string,string>")
    assert json.loads(made[0]) == {
        "$feature/a": False,
        "$feature/A": 'x"y',
        "$feature/b": True,
        "$active_feature_flags": ["A", "b"],
    }
    assert json.loads(made[1]) == {"$feature/a": False}
    assert made[2:] == ["{}", "{}"]


def test_tracked_events(spark):
    texts = ['["a","b"]', "[]", "not json", "{}", None, '"a"']
    assert column(spark, texts, pixel_settings.text_list) == [["a", "b"], [], [], [], [], []]


def test_anonymous(spark):
    rows = spark.createDataFrame(
        [("anonymized", True), ("non-anonymized", False), ("non-anonymized-by-consent", True),
         ("non-anonymized-by-consent", None), ("other", True), (None, True)],
        "s string, c boolean",
    )
    made = [r[0] for r in rows.select(shops.is_anonymous(F.col("s"), F.col("c"))).collect()]
    assert made == [True, False, False, True, True, True]


def test_form(spark):
    kind = "array<struct<id: string, name: string, value: string>>"
    forms = [[("i", "n", "1"), ("x", "n", None), ("EMAIL", "e", "a@b"), ("z", "email2", "c@d"), ("q", "", "w")]]
    assert column(spark, forms, pixel_events.form_email, kind) == ["a@b"]
    assert column(spark, forms, pixel_events.form_body, kind) == [{"n": "", "e": "a@b", "email2": "c@d"}]


@pytest.mark.parametrize(
    ("config", "bad"),
    [
        ("{}", []),
        ('{"enable_heatmaps":null,"ui_host":null}', []),
        ('{"secure_cookie":null,"persistence":"disk"}', ["secure_cookie", "persistence"]),
        ('{"session_idle_timeout_seconds":"9","property_denylist":[1]}', ["session_idle_timeout_seconds", "property_denylist"]),
        ("nonsense", ["config"]),
    ],
)
def test_script_config(spark, config, bad):
    assert column(spark, [config], settings_jobs.script_config_errors) == [bad]
