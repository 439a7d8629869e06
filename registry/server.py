"""Queries over order, refund and customer payloads, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import sample
from registry.common import Catalog
from registry.sample import view, with_views
from storewake.functions import ids, values
from storewake.operators import dedup, envelope, profiles, server_events, shops
from storewake.functions.urls import batch_url
from storewake.plans import server

catalog = Catalog()
query = catalog.query

SHOPS = view("fx_shops", sample.SHOPS)
ELIGIBLE = (
    "fx_eligible",
    "select * from fx_shops where coalesce(api_key, '') <> ''"
    " and coalesce(api_host, '') <> '' and server_enabled",
)
HEADS = view("fx_heads", sample.ORDER_HEADS)
LINES = view("fx_lines", sample.LINES)
CUSTOMERS = view("fx_customers", sample.CUSTOMERS)
REFUNDS = view("fx_refunds", sample.REFUND_HEADS)

_BLOCKED = ", ".join(f"'{b}'" for b in ids.BLOCKED_PERSON_IDS)


def _sql_valid(email: str) -> str:
    return f"(coalesce(lower(trim({email})), '') not in ({_BLOCKED}))"


def _sql_uuid5(name: str) -> str:
    digest = f"sha1(unhex('{ids.EVENT_NAMESPACE.replace('-', '')}') || encode({name}))"
    return (
        f"substr({digest},1,8)||'-'||substr({digest},9,4)||'-5'||substr({digest},14,3)||'-'||"
        f"substr('89ab', (('0x'||substr({digest},17,1))::int % 4) + 1, 1)||substr({digest},18,3)"
        f"||'-'||substr({digest},21,12)"
    )


def _sql_number(text: str) -> str:
    pattern = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return f"try_cast(nullif(regexp_extract({text}, '{pattern}', 1), '') as double)"


# Orders with their person; rows without one are gone.
PEOPLE = (
    "fx_people",
    f"""
select * from (
  select h.*, {sample.shop_name('shop_no')} as shop,
    case when has_customer and {_sql_valid('customer_email')} then lower(trim(customer_email))
         when {_sql_valid('email')} then lower(trim(email))
         when has_customer and customer_id <> 0 then 'shopify_customer_' || cast(customer_id as varchar)
    end as distinct_id
  from fx_heads h)
where distinct_id is not null""",
)
SENT = (
    "fx_sent",
    "select p.*, e.api_key, e.api_host, e.strategy from fx_people p join fx_eligible e using (shop)",
)
ORDER_VIEWS = (SHOPS, ELIGIBLE, HEADS, PEOPLE, SENT)

_CODES = """case code_kind when 2 then 'SAVE' when 3 then 'A,B' when 4 then '' end"""


def _orders(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    return shops.with_shop(sample.orders(spark, sf_dir, **options), eligible)


def _flat(events: DataFrame, *more: Column | str) -> DataFrame:
    return events.select("shop", "distinct_id", "timestamp", "uuid", *more)


@query(
    with_views(
        f"""
select shop, distinct_id, created_at as timestamp,
  case when coalesce(checkout_token, '') <> '' then {_sql_uuid5("shop || ':' || checkout_token || ':Order Completed'")} end as uuid,
  nullif(checkout_token, '') as checkout_id, cast(id as varchar) as order_id,
  nullif(order_number, 0) as order_number, nullif(name, '') as order_name, shop as affiliation,
  {_sql_number('subtotal_price')} as subtotal, {_sql_number('total_price')} as total,
  {_sql_number('subtotal_price')} as revenue, {_sql_number('shipping_amount')} as shipping,
  {_sql_number('total_tax')} as tax, {_sql_number('total_discounts')} as discount,
  {_CODES} as coupon, nullif(currency, '') as currency, nullif(source_name, '') as source_name,
  nullif(financial_status, '') as financial_status, fulfillment_status,
  case when gateway_kind = 1 then '' when gateway_kind > 1 then 'manual,card' end as payment_gateway_names,
  nullif(tags, '') as tags, nullif(referring_site, '') as referring_site, landing_site,
  case when has_customer then orders_count end as customer_orders_count,
  presentment_currency, 'server' as event_source,
  (select count(*) from fx_lines l where l.order_id = s.id) as product_count
from fx_sent s where source_name is distinct from 'web'
""",
        *ORDER_VIEWS,
        LINES,
    )
)
def order_completed(spark, sf_dir):
    events = server_events.order_completed(_orders(spark, sf_dir))
    p = "properties."
    plain = [
        "checkout_id",
        "order_id",
        "order_number",
        "order_name",
        "affiliation",
        "subtotal",
        "total",
        "revenue",
        "shipping",
        "tax",
        "discount",
        "coupon",
        "currency",
        "source_name",
        "financial_status",
        "fulfillment_status",
        "tags",
        "referring_site",
        "landing_site",
        "customer_orders_count",
        "presentment_currency",
        "event_source",
    ]
    return _flat(
        events,
        *[p + n for n in plain],
        F.array_join(p + "payment_gateway_names", ",").alias("payment_gateway_names"),
        F.size(p + "products").cast("long").alias("product_count"),
    )


_LINE_POSITION = "row_number() over (partition by l.order_id order by line_no, part, supp, ext, qty)"


@query(
    with_views(
        f"""
select s.shop, cast(s.id as varchar) as order_id,
  cast(nullif(product_id, 0) as varchar) as product_id,
  cast(nullif(variant_id, 0) as varchar) as variant_id, nullif(sku, '') as sku,
  cast(null as varchar) as category, title as name, vendor as brand,
  nullif(variant_title, '') as variant, {_sql_number('price')} as price,
  nullif(quantity, 0) as quantity,
  case when discounted then nullif({_CODES}, '') end as coupon,
  {_LINE_POSITION} as position,
  cast(null as varchar) as url, cast(null as varchar) as image_url
from fx_sent s join fx_lines l on l.order_id = s.id
where source_name is distinct from 'web'
""",
        *ORDER_VIEWS,
        LINES,
    )
)
def order_completed_products(spark, sf_dir):
    events = server_events.order_completed(_orders(spark, sf_dir))
    return events.select(
        "shop", F.col("properties.order_id").alias("order_id"), F.inline("properties.products")
    )


@query(
    with_views(
        f"""
select shop, distinct_id, coalesce(cancelled_at, updated_at) as timestamp,
  cast(null as varchar) as uuid, cast(id as varchar) as order_id,
  nullif(order_number, 0) as order_number, nullif(name, '') as order_name,
  {_sql_number('total_price')} as total, nullif(currency, '') as currency,
  nullif(cancel_reason, '') as cancel_reason, cancelled_at, shop as affiliation, source_name
from fx_sent where status = 'F'
""",
        *ORDER_VIEWS,
    )
)
def order_cancelled(spark, sf_dir):
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    rows = shops.with_shop(sample.cancelled_orders(spark, sf_dir), eligible)
    return _flat(server_events.order_cancelled(rows), "properties.*")


@query(
    with_views(
        f"""
select shop, distinct_id, updated_at as timestamp,
  case when updated_at <> '' then {_sql_uuid5("shop || ':' || cast(id as varchar) || ':' || updated_at || ':Order Updated'")} end as uuid,
  cast(id as varchar) as order_id,
  nullif(order_number, 0) as order_number, nullif(name, '') as order_name,
  nullif(financial_status, '') as financial_status, fulfillment_status,
  {_sql_number('total_price')} as total, nullif(currency, '') as currency, source_name,
  shop as affiliation
from fx_sent
""",
        *ORDER_VIEWS,
    )
)
def order_updated(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return _flat(server_events.order_updated(rows), "properties.*")


# Refunds with their email and shop.
REFUND_SENT = (
    "fx_refund_sent",
    """
select * from (
  select r.*, e.shop, e.api_key, e.api_host,
    coalesce(nullif(r.customer_email, ''), nullif(r.order_email, ''), nullif(r.email, '')) as found
  from fx_refunds r join fx_eligible e on e.shop_no = r.shop_no)
where found is not null""",
)
REFUND_LINES = (
    "fx_refund_lines",
    f"""
select *, case when amount is not null then {_sql_number('amount')} else subtotal end as refunded
from fx_lines where flag = 'R'""",
)
REFUND_VIEWS = (SHOPS, ELIGIBLE, REFUNDS, REFUND_SENT, LINES, REFUND_LINES)


def _refunds(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    return shops.with_shop(sample.refunds(spark, sf_dir, **options), eligible)


@query(
    with_views(
        """
select shop, lower(trim(found)) as distinct_id, created_at as timestamp,
  cast(null as varchar) as uuid, cast(s.order_id as varchar) as order_id,
  cast(s.id as varchar) as refund_id, round(nullif(t.total, 0), 2) as total,
  nullif(note, '') as note, shop as affiliation, t.n as product_count
from fx_refund_sent s join (
  select order_id, sum(coalesce(refunded, 0)) as total, count(*) as n
  from fx_refund_lines group by order_id) t using (order_id)
""",
        *REFUND_VIEWS,
    )
)
def order_refunded(spark, sf_dir):
    events = server_events.order_refunded(_refunds(spark, sf_dir))
    p = "properties."
    return _flat(
        events,
        p + "order_id",
        p + "refund_id",
        F.round(p + "total", 2).alias("total"),
        p + "note",
        p + "affiliation",
        F.size(p + "products").cast("long").alias("product_count"),
    )


@query(
    with_views(
        """
select shop, cast(s.id as varchar) as refund_id,
  cast(nullif(product_id, 0) as varchar) as product_id, nullif(sku, '') as sku, title as name,
  nullif(variant_title, '') as variant, vendor as brand, nullif(quantity, 0) as quantity,
  refunded as subtotal
from fx_refund_sent s join fx_refund_lines l using (order_id)
""",
        *REFUND_VIEWS,
    )
)
def order_refunded_products(spark, sf_dir):
    events = server_events.order_refunded(_refunds(spark, sf_dir))
    return events.select("shop", "properties.refund_id", F.inline("properties.products"))


@query(
    with_views(
        """
select cast(r.id as varchar) as refund_id, nullif(round(sum(coalesce(refunded, 0)), 2), 0) as total
from fx_refunds r join fx_refund_lines l using (order_id) group by r.id
""",
        REFUNDS,
        LINES,
        REFUND_LINES,
    )
)
def refund_totals(spark, sf_dir):
    """The table form: lines as rows, summed per refund."""
    lines = sample.refunds(spark, sf_dir).select(
        F.col("id").cast("string").alias("refund_id"),
        F.round(server_events.refund_total(), 2).alias("total"),
    )
    return lines


_CUSTOMER_SET = f"""
  nullif(email, '') as email, nullif(first_name, '') as first_name, last_name, phone, orders_count,
  case when total_spent = '' then 0 else {_sql_number('total_spent')} end as total_spent,
  nullif(tags, '') as tags, case when has_address then nullif(city, '') end as city,
  case when has_address then country end as country,
  case when has_address then country_code end as country_code"""

_ORDER_SET = f"""
  case when has_customer then nullif(customer_email, '') end as email,
  case when has_customer then nullif(first_name, '') end as first_name,
  case when has_customer then last_name end as last_name,
  case when has_customer then phone end as phone,
  case when has_customer then orders_count end as orders_count,
  case when not has_customer then null when total_spent = '' then 0
    else {_sql_number('total_spent')} end as total_spent,
  case when has_customer then nullif(customer_tags, '') end as tags,
  case when (has_customer and has_address) or has_billing then nullif(city, '') end as city,
  case when (has_customer and has_address) or has_billing then country end as country,
  case when (has_customer and has_address) or has_billing then country_code end as country_code,
  created_at as last_order_date, id as last_order_id,
  created_at as first_order_date, id as first_order_id"""


@query(
    with_views(
        f"""
select shop, distinct_id, created_at as timestamp, cast(null as varchar) as uuid, {_ORDER_SET}
from fx_sent where strategy = 'non-anonymized'
""",
        *ORDER_VIEWS,
    )
)
def order_identify(spark, sf_dir):
    events = server_events.order_identify(_orders(spark, sf_dir))
    return _flat(events, "properties.$set.*", "properties.$set_once.*")


CUSTOMER_SENT = (
    "fx_customer_sent",
    f"""
select c.*, e.shop, e.api_key, e.api_host,
  case when {_sql_valid('email')} then lower(trim(email))
    when id <> 0 then 'shopify_customer_' || cast(id as varchar) end as distinct_id
from fx_customers c join fx_eligible e on e.shop_no = c.shop_no
where strategy = 'non-anonymized'""",
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    return shops.with_shop(sample.customers(spark, sf_dir), eligible)


@query(
    with_views(
        f"""
select shop, distinct_id, updated_at as timestamp, cast(null as varchar) as uuid, {_CUSTOMER_SET},
  nullif(state, '') as customer_state, created_at as shopify_customer_created_at
from fx_customer_sent where distinct_id is not null
""",
        SHOPS,
        ELIGIBLE,
        CUSTOMERS,
        CUSTOMER_SENT,
    )
)
def customer_identify(spark, sf_dir):
    events = server_events.customer_identify(_customers(spark, sf_dir))
    return _flat(events, "properties.$set.*", "properties.$set_once.*")


@query(
    with_views(
        f"""
select shop, '$identify' as event, distinct_id, timestamp, cast(null as varchar) as uuid,
  api_key, api_host, set_fields, once_fields from (
  select shop, distinct_id, created_at as timestamp, api_key, api_host,
    2 + (case when has_customer then
      (coalesce(customer_email, '') <> '')::int + (coalesce(first_name, '') <> '')::int
      + (last_name is not null)::int + (phone is not null)::int + (orders_count is not null)::int
      + (total_spent is not null)::int + (coalesce(customer_tags, '') <> '')::int else 0 end)
    + (case when (has_customer and has_address) or has_billing then
      (city <> '')::int + 1 + (country_code is not null)::int else 0 end) as set_fields,
    2 as once_fields
  from fx_sent where strategy = 'non-anonymized'
  union all
  select shop, distinct_id, updated_at, api_key, api_host,
    (coalesce(email, '') <> '')::int + (first_name <> '')::int + (last_name is not null)::int
    + (phone is not null)::int + (orders_count is not null)::int + (total_spent is not null)::int
    + (tags <> '')::int + (state <> '')::int
    + (case when has_address then (city <> '')::int + 1 + (country_code is not null)::int else 0 end),
    1
  from fx_customer_sent where distinct_id is not null)
""",
        *ORDER_VIEWS,
        CUSTOMERS,
        CUSTOMER_SENT,
    )
)
def identify_events(spark, sf_dir):
    """Person updates of both feeds as JSON; fields that are not sent are absent."""
    events = envelope.all_events(
        server_events.order_identify(_orders(spark, sf_dir)),
        server_events.customer_identify(_customers(spark, sf_dir)),
    )

    def count(path: str) -> Column:
        return F.size(F.json_object_keys(F.get_json_object("properties", path)))

    return events.select(
        "shop",
        "event",
        "distinct_id",
        "timestamp",
        "uuid",
        "api_key",
        "api_host",
        count("$['$set']").alias("set_fields"),
        count("$['$set_once']").alias("once_fields"),
    )


@query(
    with_views(
        """
select e.shop, '$create_alias' as event, distinct_id, alias, api_key, api_host from (
  select distinct shop, distinct_id, 'shopify_customer_' || cast(customer_id as varchar) as alias
  from fx_people where has_customer and customer_id <> 0
    and distinct_id <> 'shopify_customer_' || cast(customer_id as varchar)) l
join fx_eligible e using (shop)
""",
        *ORDER_VIEWS,
    )
)
def alias_events(spark, sf_dir):
    """Links between a customer's number and the email the same customer orders with."""
    orders = server_events.with_order_person(sample.orders(spark, sf_dir))
    number = ids.person_id(customer_id=F.col("customer.id"))
    links = (
        orders.select("shop", "distinct_id", number.alias("alias"))
        .where(F.col("alias") != F.col("distinct_id"))
        .distinct()
        .withColumn("arrival_seq", F.lit(0))
    )
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    events = server_events.alias_events(shops.with_shop(links, eligible))
    return events.select("shop", "event", "distinct_id", "properties.alias", "api_key", "api_host")


@query(
    with_views(
        """
select regexp_replace(api_host, '/$', '') || '/batch/' as url, api_key, 'Order Updated' as event,
  distinct_id, 'storewake' as lib, '1.0.0' as lib_version, cast(id as varchar) as order_id,
  updated_at as timestamp, uuid is not null as has_uuid, 12 as property_count from (
  select *, case when updated_at <> '' then 1 end as uuid from fx_sent)
""",
        *ORDER_VIEWS,
    )
)
def event_envelope(spark, sf_dir):
    """Every "Order Updated" as the JSON the host receives, read back."""
    events = server_events.order_updated(_orders(spark, sf_dir))
    sent = envelope.enveloped(envelope.all_events(events))
    body = F.from_json(
        "body",
        "event string, timestamp string, uuid string, properties"
        " struct<distinct_id: string, `$lib`: string, `$lib_version`: string, order_id: string>",
    )
    count = F.size(F.json_object_keys(F.get_json_object("body", "$.properties")))
    return sent.select("url", "api_key", body.alias("b"), count.alias("property_count")).select(
        "url",
        "api_key",
        "b.event",
        "b.properties.distinct_id",
        F.col("b.properties.$lib").alias("lib"),
        F.col("b.properties.$lib_version").alias("lib_version"),
        "b.properties.order_id",
        "b.timestamp",
        F.col("b.uuid").isNotNull().alias("has_uuid"),
        "property_count",
    )


# Gates over orders.


@query(
    with_views(
        """
select e.shop, api_key, api_host, strategy, count(*) as orders
from fx_eligible e join fx_heads h using (shop_no) group by all
""",
        SHOPS,
        ELIGIBLE,
        HEADS,
    )
)
def eligible_shops(spark, sf_dir):
    """Eligible shops with the orders they receive."""
    eligible = shops.eligible_shops(sample.shops(spark, sf_dir))
    received = sample.orders(spark, sf_dir).groupBy("shop").agg(
        F.count("*").alias("orders")
    )
    return shops.with_shop(received, eligible)


@query(
    with_views(
        "select shop, id, source_name, distinct_id from fx_people",
        HEADS,
        PEOPLE,
    )
)
def resolvable_orders(spark, sf_dir):
    orders = server_events.with_order_person(sample.orders(spark, sf_dir))
    return orders.select("shop", "id", "source_name", "distinct_id")


@query(
    with_views(
        "select id, source_name from fx_heads where source_name is distinct from 'web'",
        HEADS,
    )
)
def non_web_orders(spark, sf_dir):
    orders = server_events.non_web(sample.orders(spark, sf_dir))
    return orders.select("id", "source_name")


@query(
    with_views(
        "select shop, id from fx_sent where strategy = 'non-anonymized'",
        *ORDER_VIEWS,
    )
)
def identify_gate(spark, sf_dir):
    orders = server_events.with_order_person(_orders(spark, sf_dir))
    return orders.where(shops.identify_allowed(F.col("strategy"))).select("shop", "id")


@query(
    with_views(
        "select id, lower(trim(found)) as distinct_id from fx_refund_sent",
        SHOPS,
        ELIGIBLE,
        REFUNDS,
        REFUND_SENT,
    )
)
def refunds_with_email(spark, sf_dir):
    rows = server_events.with_refund_email(_refunds(spark, sf_dir))
    return rows.select("id", "distinct_id")


@query(
    with_views(
        """
select shop, strategy, case when strategy = 'bogus' then 'anonymized' else strategy end as valid,
  orders from fx_shops join (select shop_no, count(*) as orders from fx_heads group by 1) using (shop_no)
""",
        SHOPS,
        HEADS,
    )
)
def valid_strategy(spark, sf_dir):
    received = sample.orders(spark, sf_dir).groupBy("shop").agg(
        F.count("*").alias("orders")
    )
    joined = shops.with_shop(received, sample.shops(spark, sf_dir))
    return joined.select(
        "shop", "strategy", shops.valid_strategy(F.col("strategy")).alias("valid"), "orders"
    )


@query(
    with_views(
        """
select ends_with(shop, '.myshopify.com') as usual, count(*) as orders,
  count(distinct shop) as shops from fx_people group by 1
""",
        HEADS,
        PEOPLE,
    )
)
def shop_domain_check(spark, sf_dir):
    """Orders of shops with an unusual domain still pass, but are counted."""
    orders = server_events.with_order_person(sample.orders(spark, sf_dir))
    return (
        orders.groupBy(shops.has_usual_domain(F.col("shop")).alias("usual"), "shop")
        .agg(F.count("*").alias("n"))
        .groupBy("usual")
        .agg(F.sum("n").alias("orders"), F.count("*").alias("shops"))
    )


@query(
    with_views(
        "select shop, id, api_key, api_host, strategy from"
        f" (select h.*, {sample.shop_name('shop_no')} as shop from fx_heads h) join fx_eligible using (shop)",
        SHOPS,
        ELIGIBLE,
        HEADS,
    )
)
def shop_enriched_orders(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    return rows.select("shop", "id", "api_key", "api_host", "strategy")


@query(
    with_views(
        """
select id, line_id, case code_kind when 2 then 'SAVE' when 3 then 'A,B' when 4 then '' end as order_coupon,
  case when discounted then case code_kind when 2 then 'SAVE' when 3 then 'A,B' end end as line_coupon
from fx_heads join fx_lines on order_id = id
""",
        HEADS,
        LINES,
    )
)
def order_coupons(spark, sf_dir):
    orders = sample.orders(spark, sf_dir)
    lines = F.arrays_zip(
        F.col("line_items.id").alias("line_id"),
        F.col("products.coupon").alias("line_coupon"),
    )
    return (
        orders.withColumn("products", server_events.order_products())
        .withColumn("order_coupon", server_events.order_coupon())
        .select("id", "order_coupon", F.inline(lines))
    )


# Columns over whole tables.


@query(
    with_views(
        f"""
select id, {_sql_number('total_price')} as total, {_sql_number('total_tax')} as tax,
  {_sql_number('shipping_amount')} as shipping from fx_heads
""",
        HEADS,
    )
)
def parse_amount(spark, sf_dir):
    shipping = F.col("total_shipping_price_set.shop_money.amount")
    return sample.orders(spark, sf_dir).select(
        "id",
        values.parse_number(F.col("total_price")).alias("total"),
        values.parse_number(F.col("total_tax")).alias("tax"),
        values.parse_number(shipping).alias("shipping"),
    )


@query(
    with_views(
        f"select id, total_price, case when total_price <> '' then {_sql_number('total_price')} end as total"
        " from fx_heads",
        HEADS,
    )
)
def update_total(spark, sf_dir):
    return sample.orders(spark, sf_dir).select(
        "id", "total_price", values.parse_truthy_number(F.col("total_price")).alias("total")
    )


@query(
    with_views(
        f"select id, case when total_spent = '' then 0 else {_sql_number('total_spent')} end as total_spent"
        " from fx_customers",
        CUSTOMERS,
    )
)
def total_spent(spark, sf_dir):
    return sample.customers(spark, sf_dir).select(
        "id", values.parse_spend(F.col("total_spent")).alias("total_spent")
    )


@query(
    with_views(
        f"select id, email, {_sql_valid('email')} as usable from fx_customers",
        CUSTOMERS,
    )
)
def valid_distinct_id(spark, sf_dir):
    return sample.customers(spark, sf_dir).select(
        "id", "email", ids.is_person_id(F.col("email")).alias("usable")
    )


@query(
    with_views(
        f"""
select id, case when has_customer and {_sql_valid('customer_email')} then lower(trim(customer_email))
  when {_sql_valid('email')} then lower(trim(email))
  when has_customer and customer_id <> 0 then 'shopify_customer_' || cast(customer_id as varchar)
  end as distinct_id from fx_heads
""",
        HEADS,
    )
)
def order_distinct_id(spark, sf_dir):
    return sample.orders(spark, sf_dir).select(
        "id", ids.order_person_id().alias("distinct_id")
    )


@query(
    with_views(
        f"""
select id, case when {_sql_valid('email')} then lower(trim(email))
  when id <> 0 then 'shopify_customer_' || cast(id as varchar) end as distinct_id from fx_customers
""",
        CUSTOMERS,
    )
)
def customer_distinct_id(spark, sf_dir):
    person = ids.person_id(F.col("email"), customer_id=F.col("id"))
    return sample.customers(spark, sf_dir).select("id", person.alias("distinct_id"))


_SHOP_HEADS = f"(select h.*, {sample.shop_name('shop_no')} as shop from fx_heads h)"


@query(
    with_views(
        f"""
select id, case when checkout_token is not null then
  {_sql_uuid5("shop || ':' || checkout_token || ':Order Completed'")} end as uuid
from {_SHOP_HEADS}
""",
        HEADS,
    )
)
def order_completed_uuid(spark, sf_dir):
    return sample.orders(spark, sf_dir).select(
        "id", ids.order_completed_uuid(F.col("shop"), F.col("checkout_token")).alias("uuid")
    )


@query(
    with_views(
        f"""
select id, case when updated_at is not null then
  {_sql_uuid5("shop || ':' || cast(id as varchar) || ':' || updated_at || ':Order Updated'")} end as uuid
from {_SHOP_HEADS}
""",
        HEADS,
    )
)
def order_updated_uuid(spark, sf_dir):
    uuid = ids.order_updated_uuid(F.col("shop"), F.col("id"), F.col("updated_at"))
    return sample.orders(spark, sf_dir).select("id", uuid.alias("uuid"))


@query(
    with_views(
        """
select shop, regexp_replace(api_host, '/$', '') || '/batch/' as url, count(*) as orders
from fx_sent group by 1, 2
""",
        *ORDER_VIEWS,
    )
)
def strip_host_slash(spark, sf_dir):
    rows = server_events.with_order_person(_orders(spark, sf_dir))
    return rows.groupBy("shop", batch_url(F.col("api_host")).alias("url")).agg(
        F.count("*").alias("orders")
    )


# Event tables.

_COMPLETED_UUID = _sql_uuid5("shop || ':' || checkout_token || ':Order Completed'")
_UPDATED_UUID = _sql_uuid5("shop || ':' || cast(id as varchar) || ':' || updated_at || ':Order Updated'")

# All server events without retries, as (shop, event, distinct_id, timestamp, uuid, key).
SERVER_EVENTS = (
    "fx_server_events",
    f"""
select shop, 'Order Completed' as event, distinct_id, created_at as timestamp,
  case when checkout_token is not null then {_COMPLETED_UUID} end as uuid, cast(id as varchar) as ref
from fx_sent where source_name is distinct from 'web'
union all
select shop, '$identify', distinct_id, created_at, null, cast(id as varchar) from fx_sent
where strategy = 'non-anonymized'
union all
select shop, 'Order Updated', distinct_id, updated_at,
  case when updated_at is not null then {_UPDATED_UUID} end, cast(id as varchar) from fx_sent
union all
select shop, '$identify', distinct_id, updated_at, null, cast(id as varchar) from fx_sent
where strategy = 'non-anonymized'
union all
select shop, 'Order Cancelled', distinct_id, coalesce(cancelled_at, updated_at), null,
  cast(id as varchar) from fx_sent where status = 'F'
union all
select shop, 'Order Refunded', lower(trim(found)), created_at, null, cast(order_id as varchar)
from fx_refund_sent
union all
select shop, '$identify', distinct_id, updated_at, null, null from fx_customer_sent
where distinct_id is not null""",
)
SERVER_VIEWS = (
    SHOPS,
    ELIGIBLE,
    HEADS,
    PEOPLE,
    SENT,
    REFUNDS,
    REFUND_SENT,
    CUSTOMERS,
    CUSTOMER_SENT,
    SERVER_EVENTS,
)


def server_event_table(spark: SparkSession, sf_dir: str, retries: bool = False) -> DataFrame:
    orders = sample.orders(spark, sf_dir, retries=retries)
    return server.server_events_table(
        sample.shops(spark, sf_dir),
        created=orders,
        updated=sample.orders(spark, sf_dir, retries=retries),
        cancelled=sample.cancelled_orders(spark, sf_dir),
        refunds=sample.refunds(spark, sf_dir),
        customers=sample.customers(spark, sf_dir),
    )


def _reference() -> Column:
    in_set = F.get_json_object("properties", "$['$set'].last_order_id")
    return F.coalesce(F.get_json_object("properties", "$.order_id"), in_set)


@query(
    with_views(
        "select shop, event, distinct_id, timestamp, uuid, ref from fx_server_events",
        *SERVER_VIEWS,
    )
)
def server_event_feed(spark, sf_dir):
    """All server channels in one table."""
    return server_event_table(spark, sf_dir).select(
        "shop", "event", "distinct_id", "timestamp", "uuid", _reference().alias("ref")
    )


@query(
    with_views(
        f"""
select shop, event, distinct_id, uuid, 0 as arrival_seq, cast(id as varchar) as order_id from (
  select *, 'Order Completed' as event, case when checkout_token is not null then {_COMPLETED_UUID} end as uuid
  from fx_sent where source_name is distinct from 'web')
union all
select shop, 'Order Completed', distinct_id, null, 1, cast(id as varchar)
from fx_sent where source_name is distinct from 'web' and checkout_token is null and id % 10 = 0
""",
        *ORDER_VIEWS,
    )
)
def deduplicated_events(spark, sf_dir):
    """Completed orders with retried webhooks; only those with a uuid are merged."""
    orders = server_events.with_order_person(_orders(spark, sf_dir, retries=True))
    events = server_events.event_table(orders, server_events.order_completed_mapping())
    return dedup.deduplicated(events).select(
        "shop",
        "event",
        "distinct_id",
        "uuid",
        "arrival_seq",
        F.get_json_object("properties", "$.order_id").alias("order_id"),
    )


# The fields of a person update that the latest and that the first one decides.
_LATEST = (
    "email", "first_name", "last_name", "phone", "orders_count", "total_spent", "tags", "city", "country",
    "country_code", "last_order_date", "last_order_id", "customer_state",
)
_FIRST = ("first_order_date", "first_order_id", "shopify_customer_created_at")


@query(
    with_views(
        f"""
select shop, distinct_id, {", ".join(f"arg_max({n}, k) filter ({n} is not null) as {n}" for n in _LATEST)},
  {", ".join(f"arg_min({n}, k) filter ({n} is not null) as {n}" for n in _FIRST)}
from (
  select shop, distinct_id, created_at || '0' || lpad(cast(id as varchar), 20, '0') as k, {_ORDER_SET},
    cast(null as varchar) as customer_state, cast(null as varchar) as shopify_customer_created_at
  from fx_sent where strategy = 'non-anonymized'
  union all by name
  select shop, distinct_id, coalesce(updated_at, '') || '1' || coalesce(created_at, '') as k, {_CUSTOMER_SET},
    nullif(state, '') as customer_state, created_at as shopify_customer_created_at
  from fx_customer_sent where distinct_id is not null) group by shop, distinct_id
""",
        *ORDER_VIEWS,
        CUSTOMERS,
        CUSTOMER_SENT,
    )
)
def person_profiles(spark, sf_dir):
    """Profiles folded from the person updates of orders and of customers, all fields."""

    def updates(events: DataFrame, feed: int, place: str) -> DataFrame:
        return events.select(
            "shop",
            "distinct_id",
            F.coalesce("timestamp", F.lit("")).alias("timestamp"),
            F.lit(feed).alias("feed"),
            F.lpad(F.col(place).cast("string"), 20, "0").alias("place"),
            "properties.$set.*",
            "properties.$set_once.*",
        )

    orders = updates(server_events.order_identify(_orders(spark, sf_dir)), 0, "properties.$set.last_order_id")
    customers = updates(
        server_events.customer_identify(_customers(spark, sf_dir)),
        1,
        "properties.$set_once.shopify_customer_created_at",
    )
    return profiles.person_profiles(
        orders.unionByName(customers, allowMissingColumns=True),
        latest=_LATEST,
        first=_FIRST,
        order=("timestamp", "feed", "place"),
    )
