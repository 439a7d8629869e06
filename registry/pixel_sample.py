"""Browser events and page loads derived from the events and pages tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.sample import ROWS_PER_FILE, landed, run_sql, table, with_shop_name

PIXEL = """
select e.event_id, e.user_id, e.ts, e.value,
  case when e.user_id % 3 = 0 then 0 else e.user_id % (n.shops + 3) end as shop_no,
  cast(floor(cast(substr(cast(e.ts as string), 9, 2) as int) / 2) as bigint) as blk,
  'c' || cast(e.user_id as string) as client_id,
  'p' || cast(e.user_id as string) || '-'
    || cast(cast(floor(cast(substr(cast(e.ts as string), 9, 2) as int) / 2) as bigint) as string) as page_load_id,
  't' || cast(e.event_id % 2 as string) as tab_id,
  case e.event_type
    when 'view' then case e.event_id % 4 when 0 then 'page_viewed' when 1 then 'collection_viewed'
      when 2 then 'product_viewed' else 'search_submitted' end
    when 'click' then case e.event_id % 4 when 0 then 'clicked' when 1 then 'product_added_to_cart'
      when 2 then 'product_removed_from_cart' else 'cart_viewed' end
    when 'signup' then 'form_submitted'
    when 'purchase' then case e.event_id % 6 when 0 then 'checkout_started' when 1 then 'checkout_completed'
      when 2 then 'checkout_shipping_info_submitted' when 3 then 'checkout_contact_info_submitted'
      when 4 then 'checkout_address_info_submitted' else 'payment_info_submitted' end
    else case when e.event_id % 2 = 0 then 'input_focused' else 'input_changed' end end as name,
  case e.event_id % 3 when 0 then '' when 1 then 'sh-' else 'bad' end
    || substr(md5(cast(e.event_id as string)), 1, 8) || '-' || substr(md5(cast(e.event_id as string)), 9, 4)
    || '-' || substr(md5(cast(e.event_id as string)), 13, 4) || '-' || substr(md5(cast(e.event_id as string)), 17, 4)
    || '-' || substr(md5(cast(e.event_id as string)), 21, 12) as id,
  replace(substr(cast(e.ts as string), 1, 19), ' ', 'T') || 'Z' as timestamp,
  case when e.event_id % 97 = 96 then 'not a url'
    when e.event_id % 4 = 0 then p.url
    when e.event_id % 4 = 1 then 'https://store.example.com/p/' || cast(e.event_id as string)
      || '?utm_source=a%20b+c&utm_source=z&gclid=g' || cast(e.event_id as string)
    when e.event_id % 4 = 2 then 'https://store.example.com:8443/c?utm_campaign=&utm_medium=m'
      || cast(e.event_id % 7 as string) || '#top'
    else 'HTTPS://u:p@Store.Example.com:443' end as href
from {events} e
  join (select count(*) as shops, 1 as one from {supplier}) n on n.one = 1
  join (select count(*) as pages, 1 as one from {pages}) m on m.one = 1
  left join {pages} p on p.page_id = e.event_id % m.pages
"""

# One row per page load; first_id is the load's first event.
LOADS = """
select user_id, blk, shop_no, client_id, page_load_id, min(ts) as loaded, min(event_id) as first_id
from fx_px group by user_id, blk, shop_no, client_id, page_load_id
"""

LOAD_FACTS = """
select l.*, e.href,
  case l.first_id % 7 when 0 then null when 1 then 'https://www.google.com/search?q=x'
    when 2 then 'https://www.bing.com/' when 3 then 'http://search.yahoo.com'
    when 4 then 'https://duckduckgo.com/' when 5 then 'https://x.example.com:8080/?u=google.com'
    else '' end as referrer,
  case l.first_id % 5
    when 0 then 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.' || cast(l.user_id % 9 as string) || ' Safari/537.36'
    when 1 then 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_' || cast(l.user_id % 4 as string) || ' like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1'
    when 2 then 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/12' || cast(l.user_id % 3 as string) || '.0'
    when 3 then 'unknown agent'
    else null end as user_agent,
  cast(600 + l.first_id % 500 as int) as screen_height,
  cast(800 + l.first_id % 700 as int) as screen_width,
  (l.user_id + l.blk) % 4 = 0 as has_customer,
  'cu' || cast(l.user_id as string) as customer_id,
  case when (l.user_id + l.blk) % 8 = 0 then 'Login' || cast(l.user_id as string) || '@Example.com'
    when l.user_id % 5 = 0 then null else 'user' || cast(l.user_id as string) || '@example.com' end as customer_email,
  (l.user_id + l.blk) % 5 < 2 as has_cart,
  'lc' || cast(l.user_id as string) as load_cart_id,
  cast(l.user_id % 6 as int) as load_cart_quantity,
  case when l.user_id % 2 = 0 then 'Last' || cast(l.user_id as string) end as last_name,
  case when (l.user_id + l.blk) % 7 <> 0 then (l.user_id + l.blk) % 3 <> 0 end as analytics_allowed,
  l.first_id % 4 as flag_kind
from fx_loads l join fx_px e on e.event_id = l.first_id
"""

# Numbers of a variant: i is the event, j its place; i + j decides its gaps.
_VARIANT = """named_struct(
  'id', concat('v', event_id, '-', {j}),
  'title', case when (event_id + {j}) % 6 = 0 then '' else concat('Var ', {j}) end,
  'sku', case when (event_id + {j}) % 5 = 0 then '' else concat('S', (event_id + {j}) % 50) end,
  'weight', cast(event_id % 12 as int),
  'price', named_struct('amount', case when (event_id + {j}) % 8 = 0 then 0.0D else value end,
    'currencyCode', 'USD'),
  'image', case when (event_id + {j}) % 4 <> 0
    then named_struct('src', concat('https://img.example.com/', event_id + {j})) end,
  'product', named_struct('id', concat('p', (event_id + {j}) % 100),
    'title', case when (event_id + {j}) % 9 = 0 then '' else concat('Product ', (event_id + {j}) % 100) end,
    'url', concat('/products/', (event_id + {j}) % 100)))"""

_CHECKOUT = """named_struct(
  'token', case when event_id % 11 = 0 then '' else concat('tok', event_id) end,
  'email', case when event_id % 5 = 0 then null
    when event_id % 7 = 0 then concat('Buyer', user_id, '@Example.com')
    else concat('user', user_id, '@example.com') end,
  'phone', case when event_id % 2 = 0 then concat('+1', user_id) end,
  'smsMarketingPhone', cast(null as string),
  'currencyCode', 'USD',
  'subtotalPrice', case when event_id % 13 <> 0 then named_struct('amount', value) end,
  'totalPrice', named_struct('amount', case when event_id % 6 = 0 then 0.0D else value * 2 end),
  'totalTax', named_struct('amount', case when event_id % 4 = 0 then 0.0D else value / 4 end),
  'discountsAmount', case when event_id % 5 <> 1
    then named_struct('amount', case when event_id % 5 = 2 then 0.0D else 1.25D end) end,
  'shippingLine', case when event_id % 3 <> 0 then named_struct('price', named_struct('amount', 5.5D)) end,
  'billingAddress', named_struct('city', 'Paris', 'country', 'FR', 'zip', cast(user_id as string)),
  'shippingAddress', case when event_id % 2 = 0
    then named_struct('city', 'Lyon', 'country', 'FR', 'zip', cast(user_id as string)) end,
  'order', case when event_id % 4 <> 0
    then named_struct('id', concat('o', event_id), 'name', concat('#', event_id),
      'customer', named_struct('id', concat('oc', user_id), 'isFirstOrder', user_id % 2 = 0)) end,
  'note', concat('n', event_id % 3),
  'transactions', transform(slice(array(1, 2), 1, cast(event_id % 3 as int)),
    j -> named_struct('paymentMethod', case when (event_id + j) % 4 <> 0 then concat('pay', j) end)),
  'delivery', case when event_id % 9 <> 0 then named_struct('selectedDeliveryOptions',
    transform(slice(array(1, 2), 1, cast(user_id % 3 as int)), j -> named_struct('title', concat('ship', j)))) end,
  'discountApplications', transform(slice(array(1, 2), 1, cast((event_id + user_id) % 3 as int)),
    j -> named_struct('title', case when (event_id + j) % 5 <> 0 then concat('disc', j) end)),
  'lineItems', transform(slice(array(1, 2, 3), 1, cast(event_id % 4 as int)), j -> named_struct(
    'id', concat('l', event_id, '-', j), 'title', concat('Item ', j), 'quantity', j,
    'finalLinePrice', named_struct('amount', value * j),
    'variant', case when (event_id + j) % 7 <> 0 then named_struct(
      'sku', case when (event_id + j) % 5 = 0 then '' else concat('S', j) end,
      'title', concat('V', j),
      'untranslatedTitle', case when (event_id + j) % 3 = 0 then '' else concat('U', j) end,
      'product', named_struct('url', concat('/p/', j)),
      'image', case when (event_id + j) % 4 <> 0 then named_struct('src', concat('img', j)) end) end,
    'discountAllocations', transform(slice(array(1, 2), 1, cast((event_id + j) % 3 as int)),
      a -> named_struct('discountApplication', named_struct('title', concat('al', a)))))))"""

_ELEMENT = """case when name = 'form_submitted' then named_struct(
    'id', concat('form', event_id % 10), 'name', cast(null as string), 'type', 'form', 'value', cast(null as string),
    'href', cast(null as string), 'action', '/contact', 'elements', array(
      named_struct('id', 'f1', 'name', 'name', 'value', concat('N', user_id)),
      named_struct('id', case when event_id % 4 = 0 then 'other' else 'Email_input' end, 'name', 'contact',
        'value', case when event_id % 3 = 0 then '' else concat('Form', user_id, '@example.com') end),
      named_struct('id', 'f3', 'name', case when event_id % 2 = 0 then 'name' else 'note' end, 'value', cast(null as string)),
      named_struct('id', 'f4', 'name', cast(null as string), 'value', 'unnamed'),
      named_struct('id', 'f5', 'name', 'backup_EMAIL', 'value', 'second@example.com')))
  when name in ('clicked', 'input_changed') then named_struct(
    'id', concat('el', event_id % 10), 'name', cast(null as string), 'type', 'button', 'value', concat('b', event_id % 3),
    'href', cast(null as string), 'action', cast(null as string),
    'elements', cast(null as array<struct<id: string, name: string, value: string>>)) end"""


def _variants(count: str) -> str:
    return (
        f"transform(slice(array(1, 2, 3), 1, cast({count} as int)), j -> "
        + _VARIANT.replace("{j}", "j")
        + ")"
    )


_ZERO = _VARIANT.replace("{j}", "0")
_PAYLOADS = {
    "checkout": f"case when name like 'checkout%' or name = 'payment_info_submitted' then {_CHECKOUT} end",
    "cart_line": "case when name in ('product_added_to_cart', 'product_removed_from_cart') and event_id % 10 <> 1"
    " then named_struct('quantity', cast(event_id % 4 as int),"
    f" 'cost', named_struct('totalAmount', named_struct('amount', value * 3)), 'merchandise', {_ZERO}) end",
    "cart": "case when name = 'cart_viewed' and event_id % 10 <> 3 then named_struct('id',"
    " case when event_id % 7 = 0 then '' else concat('cart', user_id) end, 'lines',"
    " transform(slice(array(1, 2, 3), 1, cast(user_id % 4 as int)), j -> named_struct('quantity', j,"
    f" 'merchandise', {_VARIANT.replace('{j}', 'j')}))) end",
    "collection": "case when name = 'collection_viewed' then named_struct('id', concat('col', event_id % 20),"
    f" 'title', 'Col', 'productVariants', {_variants('user_id % 4')}) end",
    "product_variant": f"case when name = 'product_viewed' then {_ZERO} end",
    "search_result": "case when name = 'search_submitted' then named_struct('query', concat('q', event_id % 50),"
    f" 'productVariants', {_variants('user_id % 4')}) end",
    "element": _ELEMENT,
}


def _micros(col: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {col})")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "pixel_flat", _flat_events, spread=False)


def _flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The given rows are spread, not the texts made of them.
    events = table(spark, sf_dir, "events").drop("props")
    files = max(spark.sparkContext.defaultParallelism, events.count() // ROWS_PER_FILE)
    spread = events.repartition(files)
    return with_shop_name(run_sql(spark, sf_dir, PIXEL.replace("{events}", "{spread}"), spread=spread), keep=True)


def pixel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "pixel_events", _pixel_events, spread=False)


def _pixel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_events(spark, sf_dir).select(
        "shop",
        "event_id",
        "id",
        "name",
        "client_id",
        "tab_id",
        "page_load_id",
        "timestamp",
        _micros("ts").alias("ts_us"),
        "href",
        *[F.expr(text).alias(name) for name, text in _PAYLOADS.items()],
    )


def page_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "page_loads", _page_loads, spread=False)


def _page_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = flat_events(spark, sf_dir)
    loads = spark.sql(LOADS.replace("fx_px", "{px}"), px=px)
    facts = spark.sql(LOAD_FACTS.replace("fx_px", "{px}").replace("fx_loads", "{loads}"), px=px, loads=loads)
    none = F.lit(None).cast("string")
    customer = F.when(
        F.col("has_customer"),
        F.struct(
            F.col("customer_id").alias("id"),
            F.col("customer_email").alias("email"),
            F.lit("Ann").alias("firstName"),
            F.col("last_name").alias("lastName"),
            none.alias("phone"),
            F.col("load_cart_quantity").alias("ordersCount"),
        ),
    )
    cart = F.when(
        F.col("has_cart"),
        F.struct(
            F.col("load_cart_id").alias("id"),
            F.col("load_cart_quantity").alias("totalQuantity"),
            F.array(F.struct(F.lit("gift").alias("key"), none.alias("value"))).alias("attributes"),
        ),
    )
    flags = (
        F.when(F.col("flag_kind") == 1, F.create_map(F.lit("beta"), F.lit("true"), F.lit("alpha"), F.lit("false")))
        .when(F.col("flag_kind") == 2, F.create_map(F.lit("exp"), F.lit("control"), F.lit("a_b"), F.lit("true")))
        .when(F.col("flag_kind") == 3, F.create_map(F.lit("off"), F.lit("false")))
    )
    return with_shop_name(facts).select(
        "shop",
        "client_id",
        "page_load_id",
        _micros("loaded").alias("loaded_us"),
        "href",
        "referrer",
        "user_agent",
        "screen_height",
        "screen_width",
        (F.col("screen_height") - 100).alias("inner_height"),
        (F.col("screen_width") - 20).alias("inner_width"),
        customer.alias("customer"),
        cart.alias("cart"),
        "analytics_allowed",
        flags.alias("feature_flags"),
    )

