"""Queries over browser events, page loads and their settings, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import pixel_sample, sample, server, state
from registry.common import Catalog
from registry.sample import with_views
from storewake.functions import ids, urls
from storewake.operators import browser_state as bs
from storewake.operators import agents, dedup, envelope, page_context, pixel_events, pixel_settings
from storewake.operators import spec_events as spec
from storewake.operators.joins import lookup_join
from storewake.operators.shops import is_anonymous, with_pixel_key
from storewake.plans import pixel
from storewake.session import land

catalog = Catalog()
query = catalog.query

PX, LOADS, FACTS, SHOPS, CONTEXTS = state.PX, state.LOADS, state.FACTS, state.SHOPS, state.CONTEXTS

_SWITCH = """case when name in ('checkout_started', 'checkout_completed') then on_checkout
  when name = 'page_viewed' then on_page when name = 'search_submitted' then on_search end"""
_TRACKED = "coalesce(tracked_events, '') like '%\"' || name || '\"%'"

# Subscribed events with their context.
SUB = (
    "fx_sub",
    f"""
select e.*, c.shop, c.anonymous, c.spec_enabled, c.has_customer, c.customer_id, c.customer_email,
  c.has_cart, c.load_cart_id, c.load_cart_quantity, c.last_name, c.href as load_href, c.loaded_us,
  case when e.name like 'checkout%' then 1 when e.name = 'payment_info_submitted' then 1 else 0 end as is_checkout
from fx_px e join fx_contexts c using (page_load_id)
where e.name <> 'input_focused' and ({_TRACKED} or ({_SWITCH}) = 'true')
  and ({_SWITCH}) is distinct from 'false'""",
)
VIEWS = (SHOPS, PX, LOADS, FACTS, CONTEXTS, SUB)

_NAMES = "case name " + " ".join(f"when '{k}' then '{v}'" for k, v in spec.EVENT_NAMES.items()) + " else name end"
_EVENT = f"case when spec_enabled then {_NAMES} else name end"
# The load's customer is spread first and its cart then, so the cart's id wins.
_LOAD_ID = "case when has_cart then load_cart_id when has_customer then customer_id end"
_LOAD_QUANTITY = "case when has_cart then load_cart_quantity end"
_ORDERS = "case when has_customer then load_cart_quantity end"
_UUID = "case event_id % 3 when 0 then id when 1 then substr(id, 4) end"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_sample.pixel_events(spark, sf_dir)


def _shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel_settings.pixel_shops(sample.pixel_settings(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscribed events with their context and placeholder state columns."""
    rows = pixel.context_rows(
        _events(spark, sf_dir),
        pixel_sample.page_loads(spark, sf_dir),
        sample.pixel_settings(spark, sf_dir),
    )
    return rows.withColumns({c: F.lit(c) for c in ("distinct_id", "session_id", "window_id")})


def _family(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return pixel_events.pixel_events(_rows(spark, sf_dir).where(F.col("name").isin(*names))).select(
        F.col("arrival_seq").alias("event_id"), "name", "event", "uuid", "properties"
    )


def _get(path: str) -> Column:
    return F.get_json_object("properties", path)


def _written_null(*keys: str) -> Column:
    found = F.lit(True)
    for key in keys:
        found = found & F.col("properties").contains(f'"{key}":null')
    return found


def _has(key: str) -> Column:
    return F.array_contains(F.json_object_keys("properties"), key)


# Settings and gates.


@query(
    with_views(
        f"""
select shop, name, ({_TRACKED} or coalesce(({_SWITCH}) = 'true', false)) as active, count(*) as events
from fx_px join fx_shops using (shop_no) where coalesce(api_key, '') <> '' group by all
""",
        SHOPS,
        PX,
    )
)
def active_events(spark, sf_dir):
    joined = lookup_join(_events(spark, sf_dir), _shops(spark, sf_dir), "shop")
    active = F.array_contains("active", F.col("name"))
    return joined.groupBy("shop", "name", active.alias("active")).agg(F.count("*").alias("events"))


@query(
    with_views(
        f"""
select shop, name, count(*) as events from fx_px join fx_shops using (shop_no)
where coalesce(api_key, '') <> '' and ({_SWITCH}) = 'false' group by all
""",
        SHOPS,
        PX,
    )
)
def merchant_opt_out(spark, sf_dir):
    joined = lookup_join(_events(spark, sf_dir), _shops(spark, sf_dir), "shop")
    out = joined.where(pixel_settings.opted_out(F.col("switches"), F.col("name")))
    return out.groupBy("shop", "name").agg(F.count("*").alias("events"))


@query(
    with_views(
        f"""
select event_id, shop, name from fx_px join fx_shops using (shop_no)
where coalesce(api_key, '') <> '' and name <> 'input_focused'
  and ({_TRACKED} or ({_SWITCH}) = 'true') and ({_SWITCH}) is distinct from 'false'
""",
        SHOPS,
        PX,
    )
)
def subscribed_events(spark, sf_dir):
    rows = pixel_settings.subscribed_events(_events(spark, sf_dir), _shops(spark, sf_dir))
    return rows.select("event_id", "shop", "name")


@query(
    with_views(
        """
select f.page_load_id, s.shop, case strategy when 'non-anonymized' then false
  when 'non-anonymized-by-consent' then not coalesce(analytics_allowed, false) else true end as anonymous
from fx_facts f join fx_shops s using (shop_no)
""",
        SHOPS,
        PX,
        LOADS,
        FACTS,
    )
)
def anonymous_flag(spark, sf_dir):
    shops = sample.shops(spark, sf_dir).select("shop", "strategy")
    loads = lookup_join(pixel_sample.page_loads(spark, sf_dir), shops, "shop")
    flag = is_anonymous(F.col("strategy"), F.col("analytics_allowed"))
    return loads.select("page_load_id", "shop", flag.alias("anonymous"))


@query(
    with_views(
        """
select coalesce(api_key, '') <> '' as has_key, count(*) as events, count(distinct shop) as shops
from fx_px join fx_shops using (shop_no) group by 1
""",
        SHOPS,
        PX,
    )
)
def pixel_key_present(spark, sf_dir):
    """Events of shops with and without a key; the latter produce nothing."""
    settings = sample.pixel_settings(spark, sf_dir).select("shop", "api_key")
    keyed = with_pixel_key(settings).select("shop", F.lit(True).alias("has_key"))
    marked = settings.join(keyed, "shop", "left").select(
        "shop", F.coalesce("has_key", F.lit(False)).alias("has_key")
    )
    per_shop = lookup_join(_events(spark, sf_dir), marked, "shop").groupBy("has_key", "shop")
    return (
        per_shop.agg(F.count("*").alias("n"))
        .groupBy("has_key")
        .agg(F.sum("n").alias("events"), F.count("*").alias("shops"))
    )


_FORM_EMAIL = """case when event_id % 4 = 0 then 'second@example.com' when event_id % 3 = 0 then ''
  else 'Form' || cast(user_id as varchar) || '@example.com' end"""


@query(
    with_views(f"select event_id, {_FORM_EMAIL} as email from fx_px where name = 'form_submitted'", PX)
)
def email_field_match(spark, sf_dir):
    forms = _events(spark, sf_dir).where(F.col("name") == "form_submitted")
    email = pixel_events.form_email(F.col("element.elements"))
    return forms.select("event_id", email.alias("email"))


@query(
    with_views(
        """
select event_id, case when event_id % 2 = 0 then '' else 'N' || cast(user_id as varchar) end as name,
  case when event_id % 2 = 1 then '' end as note,
  case when event_id % 3 = 0 then '' else 'Form' || cast(user_id as varchar) || '@example.com' end as contact,
  cast(null as varchar) as unnamed
from fx_px where name = 'form_submitted'
""",
        PX,
    )
)
def form_body(spark, sf_dir):
    forms = _events(spark, sf_dir).where(F.col("name") == "form_submitted")
    body = forms.select("event_id", pixel_events.form_body(F.col("element.elements")).alias("b"))
    return body.select("event_id", *[F.col("b")[n].alias(n) for n in ("name", "note", "contact", "unnamed")])


# Renaming and the vocabulary.


@query(
    with_views(f"select event_id, name, {_EVENT} as event from fx_sub", *VIEWS)
)
def event_rename(spark, sf_dir):
    rows = spec.rename_events(_rows(spark, sf_dir))
    return rows.select("event_id", "name", "event")


@query(with_views(f"select name, {_NAMES} as event, count(*) as events from fx_px group by 1, 2", PX))
def event_name_lookup(spark, sf_dir):
    named = _events(spark, sf_dir).groupBy("name").agg(F.count("*").alias("events"))
    return named.select("name", spec.spec_name(F.col("name")).alias("event"), "events")


@query(
    with_views(
        """
select event_id, name, case name when 'checkout_contact_info_submitted' then 1
  when 'checkout_address_info_submitted' then 2 when 'checkout_shipping_info_submitted' then 3
  when 'payment_info_submitted' then 4 else 0 end as step from fx_px
""",
        PX,
    )
)
def checkout_step_number(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id", "name", spec.step_number(F.col("name")).alias("step")
    )


@query(
    with_views(
        """
select event_id, name, case name when 'search_submitted' then 5 when 'collection_viewed' then 3
  when 'product_viewed' then 14 when 'product_added_to_cart' then 13
  when 'product_removed_from_cart' then 13 when 'cart_viewed' then 2 when 'checkout_started' then 10
  when 'checkout_completed' then 12 when 'payment_info_submitted' then 5
  when 'checkout_address_info_submitted' then 4 when 'checkout_contact_info_submitted' then 4
  when 'checkout_shipping_info_submitted' then 4 else 0 end as fields from fx_px
""",
        PX,
    )
)
def spec_dispatch(spark, sf_dir):
    """How many extra fields each event gets, over all names in one pass."""
    text = spec.spec_text(F.col("name"))
    fields = F.size(F.json_object_keys(text))
    return _events(spark, sf_dir).select("event_id", "name", fields.alias("fields"))


def _spec_rows(spark: SparkSession, sf_dir: str, mapping, *names: str) -> DataFrame:
    rows = _events(spark, sf_dir).where(F.col("name").isin(*names))
    return rows.select("event_id", spec.as_struct(mapping()).alias("s"))


def _sql_variant(j: str) -> dict[str, str]:
    n = f"(event_id + {j})"
    return {
        "id": f"'v' || cast(event_id as varchar) || '-' || cast({j} as varchar)",
        "title": f"case when {n} % 6 <> 0 then 'Var ' || cast({j} as varchar) end",
        "sku": f"case when {n} % 5 <> 0 then 'S' || cast({n} % 50 as varchar) end",
        "price": f"case when {n} % 8 = 0 then 0 else value end",
        "image": f"case when {n} % 4 <> 0 then 'https://img.example.com/' || cast({n} as varchar) end",
        "product": f"'p' || cast({n} % 100 as varchar)",
        "product_title": f"case when {n} % 9 <> 0 then 'Product ' || cast({n} % 100 as varchar) end",
        "url": f"'/products/' || cast({n} % 100 as varchar)",
    }


_J = _sql_variant("j")
_Z = _sql_variant("0")
_N = "cast(null as varchar)"

_LISTED_SQL = f"""
  {_N} as category, {_N} as brand, {_N} as coupon, {_J['product_title']} as name,
  {_J['image']} as image_url, j as position, {_J['price']} as price, {_J['id']} as product_id,
  {_J['sku']} as sku, {_J['url']} as url, 1 as quantity, {_J['title']} as variant
from fx_px, unnest(range(1, user_id % 4 + 1)) t(j)"""


@query(
    with_views(
        f"""
select event_id, 'q' || cast(event_id % 50 as varchar) as query, 0 as sorts, {_LISTED_SQL}
where name = 'search_submitted'
""",
        PX,
    )
)
def spec_product_list_filtered(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.product_list_filtered, "search_submitted")
    return rows.select(
        "event_id",
        F.col("s.filters")[0]["value"].alias("query"),
        F.size("s.sorts").alias("sorts"),
        F.inline("s.products"),
    )


@query(
    with_views(
        f"""
select event_id, 'col' || cast(event_id % 20 as varchar) as list_id, {_LISTED_SQL}
where name = 'collection_viewed'
""",
        PX,
    )
)
def spec_product_list_viewed(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.product_list_viewed, "collection_viewed")
    return rows.select("event_id", "s.list_id", F.inline("s.products"))


@query(
    with_views(
        f"""
select event_id, {_N} as brand, {_N} as category, {_N} as coupon, cast(null as int) as position,
  {_Z['image']} as image_url, {_Z['product_title']} as name, nullif({_Z['price']}, 0) as price,
  nullif({_Z['price']}, 0) as value, {_Z['product']} as product_id, 1 as quantity, {_Z['sku']} as sku,
  {_Z['url']} as url, {_Z['title']} as variant, 'USD' as currency
from fx_px where name = 'product_viewed'
""",
        PX,
    )
)
def spec_product_viewed(spark, sf_dir):
    return _spec_rows(spark, sf_dir, spec.product_viewed, "product_viewed").select("event_id", "s.*")


def _if_line(text: str) -> str:
    return f"case when event_id % 10 <> 1 then {text} end"


@query(
    with_views(
        f"""
select event_id, {_N} as brand, {_N} as cart_id, {_N} as category, {_N} as coupon,
  cast(null as int) as position, {_if_line(_Z['image'])} as image_url,
  {_if_line(_Z['product_title'])} as name, {_if_line('nullif(' + _Z['price'] + ', 0)')} as price,
  {_if_line(_Z['product'])} as product_id, {_if_line('nullif(event_id % 4, 0)')} as quantity,
  {_if_line(_Z['sku'])} as sku, {_if_line(_Z['url'])} as url, {_if_line(_Z['title'])} as variant
from fx_px where name in ('product_added_to_cart', 'product_removed_from_cart')
""",
        PX,
    )
)
def spec_product_added_removed(spark, sf_dir):
    names = pixel_settings.CART_LINE_EVENTS
    return _spec_rows(spark, sf_dir, spec.product_added_or_removed, *names).select("event_id", "s.*")


@query(
    with_views(
        f"""
select event_id, case when event_id % 10 <> 3 and event_id % 7 <> 0 then 'cart' || cast(user_id as varchar) end as cart_id,
  j as position, {_N} as brand, {_J['title']} as name, {_J['title']} as variant,
  case when j is not null then {_J['price']} end as price, {_J['product']} as product_id, j as quantity, {_J['sku']} as sku, {_J['url']} as url,
  {_J['image']} as image_url
from fx_px left join unnest(range(1, 4)) t(j) on j <= user_id % 4 and event_id % 10 <> 3
where name = 'cart_viewed'
""".replace(
            _J["title"], f"case when j is not null then {_J['title']} end"
        ),
        PX,
    )
)
def spec_cart_viewed(spark, sf_dir):
    """Carts without lines keep a row of nulls."""
    rows = _spec_rows(spark, sf_dir, spec.cart_viewed, "cart_viewed")
    opened = rows.select("event_id", "s.cart_id", F.inline_outer("s.products"))
    return opened.drop("category", "coupon")


_TITLES2 = "case when (event_id + {j}) % 5 <> 0 then 'disc' || cast({j} as varchar) else '' end"
_CHECKOUT_COUPON = f"""case (event_id + user_id) % 3 when 1 then {_TITLES2.format(j=1)}
  when 2 then {_TITLES2.format(j=1)} || ',' || {_TITLES2.format(j=2)} end"""
_PAY = "case when (event_id + {j}) % 4 <> 0 then 'pay{j}' else '' end"
_PAYMENT = f"""case event_id % 3 when 1 then {_PAY.format(j=1)}
  when 2 then {_PAY.format(j=1)} || ',' || {_PAY.format(j=2)} end"""
_SHIPPING = """case when event_id % 9 <> 0 then
  case user_id % 3 when 1 then 'ship1' when 2 then 'ship1?ship2' end end"""
_TOKEN = "case when event_id % 11 = 0 then '' else 'tok' || cast(event_id as varchar) end"
_ORDER_ID = "case when event_id % 4 <> 0 then 'o' || cast(event_id as varchar) end"
_SUBTOTAL = "case when event_id % 13 <> 0 then nullif(value, 0) end"
_TOTAL = "case when event_id % 6 <> 0 then nullif(value * 2, 0) end"
_AMOUNTS = f"""{_SUBTOTAL} as revenue, case when event_id % 3 <> 0 then 5.5::double end as shipping,
  case when event_id % 4 <> 0 then nullif(value / 4, 0) end as tax,
  case when event_id % 5 not in (1, 2) then 1.25::double end as discount,
  {_CHECKOUT_COUPON} as coupon, 'USD' as currency"""
_LINE_COUPON = "case (event_id + j) % 3 when 1 then 'al1' when 2 then 'al1,al2' end"
_HAS_VARIANT = "(event_id + j) % 7 <> 0"
_LINES_SQL = f"""'l' || cast(event_id as varchar) || '-' || cast(j as varchar) as product_id,
  case when {_HAS_VARIANT} and (event_id + j) % 5 <> 0 then 'S' || cast(j as varchar) end as sku,
  'Item ' || cast(j as varchar) as name,
  case when {_HAS_VARIANT} then case when (event_id + j) % 3 = 0 then 'V' else 'U' end || cast(j as varchar) end as variant,
  value * j as price, j as quantity, {_LINE_COUPON} as line_coupon, j as position,
  case when {_HAS_VARIANT} then '/p/' || cast(j as varchar) end as url,
  case when {_HAS_VARIANT} and (event_id + j) % 4 <> 0 then 'img' || cast(j as varchar) end as image_url
from fx_px left join unnest(range(1, 4)) t(j) on j <= event_id % 4"""


def _checkout_lines(rows: DataFrame) -> DataFrame:
    head = [c for c in rows.select("s.*").columns if c != "products"]
    opened = rows.select("event_id", *[f"s.{c}" for c in head], F.explode_outer("s.products").alias("p"))
    line = ["product_id", "sku", "name", "variant", "price", "quantity", "position", "url", "image_url"]
    return opened.select(
        "event_id", *head, *[f"p.{c}" for c in line], F.col("p.coupon").alias("line_coupon")
    )


_SHOP = f"(select f.*, {sample.shop_name('shop_no')} as shop from fx_px f)"


@query(
    with_views(
        f"""
select event_id, {_TOKEN} as order_id, shop as affiliation, {_TOTAL} as value, {_AMOUNTS}, {_LINES_SQL}
where name = 'checkout_started'
""".replace("from fx_px", f"from {_SHOP}"),
        PX,
    )
)
def spec_checkout_started(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.checkout_started, "checkout_started")
    return _checkout_lines(rows)


@query(
    with_views(
        f"""
select event_id, nullif({_TOKEN}, '') as checkout_id, {_ORDER_ID} as order_id, shop as affiliation,
  {_SUBTOTAL} as subtotal, {_TOTAL} as total, {_AMOUNTS}, {_LINES_SQL}
where name = 'checkout_completed'
""".replace("from fx_px", f"from {_SHOP}"),
        PX,
    )
)
def spec_order_completed(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.order_completed, "checkout_completed")
    return _checkout_lines(rows)


@query(
    with_views(
        f"""
select event_id, {_TOKEN} as checkout_id, {_PAYMENT} as payment_method, {_SHIPPING} as shipping_method,
  case name when 'checkout_contact_info_submitted' then 1 when 'checkout_address_info_submitted' then 2
    else 3 end as step
from fx_px where name in ('checkout_contact_info_submitted', 'checkout_address_info_submitted',
  'checkout_shipping_info_submitted')
""",
        PX,
    )
)
def spec_checkout_step(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.checkout_step_completed, *spec.STEP_EVENTS)
    return rows.select("event_id", "s.*")


@query(
    with_views(
        f"""
select event_id, {_TOKEN} as checkout_id, {_ORDER_ID} as order_id, {_PAYMENT} as payment_method,
  {_SHIPPING} as shipping_method, 4 as step
from fx_px where name = 'payment_info_submitted'
""",
        PX,
    )
)
def spec_payment_info(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir, spec.payment_info_entered, "payment_info_submitted")
    return rows.select("event_id", "s.*")


_IS_CHECKOUT = "(name like 'checkout%' or name = 'payment_info_submitted')"


def _checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(F.col("name").isin(*pixel_settings.CHECKOUT_EVENTS))


@query(
    with_views(
        f"""
select event_id, {_CHECKOUT_COUPON} as coupon, j as position, {_LINE_COUPON} as line_coupon
from fx_px left join unnest(range(1, 4)) t(j) on j <= event_id % 4 where {_IS_CHECKOUT}
""",
        PX,
    )
)
def checkout_coupons(spark, sf_dir):
    rows = _checkouts(spark, sf_dir).select("event_id", spec.as_struct(spec.order_completed()).alias("s"))
    return _checkout_lines(rows).select("event_id", "coupon", "position", "line_coupon")


@query(
    with_views(
        f"select event_id, {_PAYMENT} as payment_method, {_SHIPPING} as shipping_method"
        f" from fx_px where {_IS_CHECKOUT}",
        PX,
    )
)
def payment_and_shipping_methods(spark, sf_dir):
    return _checkouts(spark, sf_dir).select(
        "event_id",
        spec.payment_method().alias("payment_method"),
        spec.shipping_method().alias("shipping_method"),
    )


# Merged properties by family.


@query(
    with_views(
        f"""
select event_id, name, {_EVENT} as event, {_UUID} as uuid, href as current_url, client_id,
  case when anonymous then null when event_id % 5 = 0 then null
    when event_id % 7 = 0 then 'Buyer' || cast(user_id as varchar) || '@Example.com'
    else 'user' || cast(user_id as varchar) || '@example.com' end as email,
  case when not anonymous and event_id % 2 = 0 then '+1' || cast(user_id as varchar) end as phone,
  case when not anonymous then 'Paris' end as billing_city,
  case when not anonymous and event_id % 4 <> 0 then 'o' || cast(event_id as varchar) end as inner_order_id,
  case when not anonymous and event_id % 4 <> 0 then 'oc' || cast(user_id as varchar) end as order_customer_id,
  case when event_id % 6 = 0 then 0 else value * 2 end as total_price,
  case when spec_enabled then case name when 'checkout_started' then {_TOKEN}
    when 'checkout_completed' then {_ORDER_ID} when 'payment_info_submitted' then {_ORDER_ID} end end as order_id,
  case when event_id % 4 <> 0 then '#' || cast(event_id as varchar) end as order_name,
  case when event_id % 4 <> 0 then user_id % 2 = 0 end as first_order,
  'n' || cast(event_id % 3 as varchar) as note, {_LOAD_QUANTITY} as load_quantity, {_ORDERS} as orders_count,
  {_LOAD_ID} as load_id, anonymous as customer_null, true as cart_null
from fx_sub where is_checkout = 1
""",
        *VIEWS,
    )
)
def checkout_events(spark, sf_dir):
    events = _family(spark, sf_dir, *pixel_settings.CHECKOUT_EVENTS)
    return events.select(
        "event_id",
        "name",
        "event",
        "uuid",
        _get("$['$current_url']").alias("current_url"),
        _get("$.client_id").alias("client_id"),
        _get("$.email").alias("email"),
        _get("$.phone").alias("phone"),
        _get("$.billingAddress.city").alias("billing_city"),
        _get("$.order.id").alias("inner_order_id"),
        _get("$.order.customer.id").alias("order_customer_id"),
        _get("$.totalPrice.amount").cast("double").alias("total_price"),
        _get("$.order_id").alias("order_id"),
        _get("$.order.name").alias("order_name"),
        _get("$.order.customer.isFirstOrder").cast("boolean").alias("first_order"),
        _get("$.note").alias("note"),
        _get("$.totalQuantity").cast("int").alias("load_quantity"),
        _get("$.ordersCount").cast("int").alias("orders_count"),
        _get("$.id").alias("load_id"),
        _written_null("customer", "purchasingCompany").alias("customer_null"),
        _written_null("cart").alias("cart_null"),
    )


@query(
    with_views(
        f"""
select event_id, {_EVENT} as event, {_UUID} as uuid,
  case when event_id % 10 <> 1 then value * 3 end as cost,
  case when event_id % 10 <> 1 then case when spec_enabled then nullif(event_id % 4, 0) else event_id % 4 end end as quantity,
  case when event_id % 10 <> 1 then case when spec_enabled then nullif({_Z['price']}, 0) else {_Z['price']} end end as price,
  case when event_id % 10 <> 1 then {_Z['id']} else {_LOAD_ID} end as id,
  case when event_id % 10 <> 1 then event_id % 12 end as weight, {_LOAD_QUANTITY} as load_quantity,
  case when event_id % 10 <> 1 and spec_enabled then {_Z['product']} end as product_id,
  event_id % 10 <> 1 or spec_enabled as has_quantity, false as has_customer_key,
  case when spec_enabled then case when event_id % 10 <> 1 then {_Z['url']} end else href end as url
from fx_sub where name in ('product_added_to_cart', 'product_removed_from_cart')
""",
        *VIEWS,
    )
)
def cart_line_events(spark, sf_dir):
    events = _family(spark, sf_dir, *pixel_settings.CART_LINE_EVENTS)
    price = F.coalesce(_get("$.price.amount"), _get("$.price")).try_cast("double")
    return events.select(
        "event_id",
        "event",
        "uuid",
        _get("$.cost").cast("double").alias("cost"),
        _get("$.quantity").cast("int").alias("quantity"),
        price.alias("price"),
        _get("$.id").alias("id"),
        _get("$.weight").cast("int").alias("weight"),
        _get("$.totalQuantity").cast("int").alias("load_quantity"),
        _get("$.product_id").alias("product_id"),
        _has("quantity").alias("has_quantity"),
        _has("customer").alias("has_customer_key"),
        _get("$.url").alias("url"),
    )


@query(
    with_views(
        f"""
select event_id, {_EVENT} as event, {_UUID} as uuid, 'el' || cast(event_id % 10 as varchar) as id,
  'button' as type, 'b' || cast(event_id % 3 as varchar) as value, load_href as current_url, false as has_url
from fx_sub where name in ('clicked', 'input_changed')
""",
        *VIEWS,
    )
)
def dom_events(spark, sf_dir):
    return _family(spark, sf_dir, *pixel_settings.DOM_EVENTS).select(
        "event_id",
        "event",
        "uuid",
        _get("$.id").alias("id"),
        _get("$.type").alias("type"),
        _get("$.value").alias("value"),
        _get("$['$current_url']").alias("current_url"),
        _has("url").alias("has_url"),
    )


@query(
    with_views(
        f"""
select event_id, {_EVENT} as event, {_UUID} as uuid, case when anonymous then 'false' end as person_profile,
  anonymous as customer_null, case when has_customer then customer_email end as set_email,
  has_customer and not anonymous as set_replaced, href as url,
  case when has_customer and not anonymous then 6 when has_customer then 39 else 33 end as set_fields,
  {_LOAD_ID} as load_id, {_LOAD_QUANTITY} as load_quantity
from fx_sub where name = 'page_viewed'
""",
        *VIEWS,
    )
)
def page_view_events(spark, sf_dir):
    person = "$['$set']"
    return _family(spark, sf_dir, "page_viewed").select(
        "event_id",
        "event",
        "uuid",
        _get("$['$process_person_profile']").alias("person_profile"),
        _written_null("customer", "purchasingCompany").alias("customer_null"),
        _get(person + ".email").alias("set_email"),
        (~F.array_contains(F.json_object_keys(_get(person)), "$browser")).alias("set_replaced"),
        _get("$.url").alias("url"),
        F.size(F.json_object_keys(_get(person))).alias("set_fields"),
        _get("$.id").alias("load_id"),
        _get("$.totalQuantity").cast("int").alias("load_quantity"),
    )


@query(
    with_views(
        f"""
select event_id, name, {_EVENT} as event, {_UUID} as uuid,
  case name when 'collection_viewed' then 'col' || cast(event_id % 20 as varchar)
    when 'product_viewed' then {_Z['id']}
    when 'cart_viewed' then case when event_id % 10 = 3 then {_LOAD_ID}
      when event_id % 7 = 0 then '' else 'cart' || cast(user_id as varchar) end
    else {_LOAD_ID} end as id,
  case when name = 'search_submitted' then 'q' || cast(event_id % 50 as varchar) end as query,
  case when spec_enabled and name = 'collection_viewed' then 'col' || cast(event_id % 20 as varchar) end as list_id,
  case when spec_enabled and name = 'product_viewed' then {_Z['product']} end as product_id,
  case when spec_enabled and name <> 'product_viewed' then
    case when name = 'cart_viewed' and event_id % 10 = 3 then 0 else user_id % 4 end end as products,
  case when spec_enabled and name = 'product_viewed' then {_Z['url']} else href end as url
from fx_sub where name in ('collection_viewed', 'product_viewed', 'cart_viewed', 'search_submitted')
""",
        *VIEWS,
    )
)
def browse_events(spark, sf_dir):
    products = F.from_json(_get("$.products"), "array<struct<position: int>>")
    return _family(spark, sf_dir, *pixel_events.BROWSE_EVENTS).select(
        "event_id",
        "name",
        "event",
        "uuid",
        _get("$.id").alias("id"),
        _get("$.query").alias("query"),
        _get("$.list_id").alias("list_id"),
        _get("$.product_id").alias("product_id"),
        F.when(products.isNotNull(), F.size(products)).alias("products"),
        _get("$.url").alias("url"),
    )


@query(
    with_views(
        f"""
select event_id, {_EVENT} as event, {_UUID} as uuid, '/contact' as action, 5 as fields,
  case when event_id % 2 = 0 then '' else 'N' || cast(user_id as varchar) end as body_name,
  case when not anonymous and {_FORM_EMAIL} <> '' then {_FORM_EMAIL}
    when has_customer then customer_email end as set_email,
  anonymous as customer_null, load_href as current_url
from fx_sub where name = 'form_submitted'
""",
        *VIEWS,
    )
)
def form_events(spark, sf_dir):
    return _family(spark, sf_dir, "form_submitted").select(
        "event_id",
        "event",
        "uuid",
        _get("$.action").alias("action"),
        F.json_array_length(_get("$.form")).alias("fields"),
        _get("$.form_body.name").alias("body_name"),
        _get("$['$set'].email").alias("set_email"),
        _written_null("customer", "purchasingCompany").alias("customer_null"),
        _get("$['$current_url']").alias("current_url"),
    )


# Page context.

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_AUTHORITY = rf"lower(regexp_replace(regexp_extract({{u}}, '{_SCHEME}([^/?#]*)', 1), '^.*@', ''))"


def _sql_host(u: str) -> str:
    host = _AUTHORITY.format(u=u)
    return f"""nullif(case when lower({u}) like 'https:%' then regexp_replace({host}, ':443$', '')
      when lower({u}) like 'http:%' then regexp_replace({host}, ':80$', '') else {host} end, '')"""


def _sql_path(u: str) -> str:
    path = rf"regexp_extract({u}, '{_SCHEME}[^/?#]+([^?#]*)', 1)"
    return f"case when regexp_matches({u}, '{_SCHEME}[^/?#]') then case when {path} = '' then '/' else {path} end end"


def _sql_param(u: str, name: str) -> str:
    query_text = f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"
    found = f"regexp_extract('&' || {query_text}, '&{name}=([^&]*)', 1)"
    has = f"regexp_matches('&' || {query_text}, '&{name}(=|&|$)')"
    return f"case when {has} then url_decode(replace({found}, '+', ' ')) end"


@query(
    with_views(
        "select event_id, "
        + ", ".join(
            f"{_sql_param('href', p)} as {p}"
            for p in ("gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term")
        )
        + " from fx_px",
        PX,
    )
)
def campaign_params(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", urls.campaign_struct(F.col("href"), "").alias("c"))
    names = ("gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term")
    return events.select("event_id", *[f"c.{n}" for n in names])


@query(
    with_views(
        f"select event_id, href, {_sql_host('href')} as host, {_sql_path('href')} as path from fx_px", PX
    )
)
def url_parts(spark, sf_dir):
    return _events(spark, sf_dir).select(
        "event_id",
        "href",
        urls.url_host(F.col("href")).alias("host"),
        urls.url_path(F.col("href")).alias("path"),
    )


@query(
    with_views(
        f"""
select page_load_id, coalesce(nullif(referrer, ''), '$direct') as referrer,
  coalesce({_sql_host('referrer')}, '$direct') as domain from fx_facts
""",
        PX,
        LOADS,
        FACTS,
    )
)
def referrer(spark, sf_dir):
    return pixel_sample.page_loads(spark, sf_dir).select(
        "page_load_id",
        urls.referrer_or_direct(F.col("referrer")).alias("referrer"),
        urls.referring_domain(F.col("referrer")).alias("domain"),
    )


_ENGINE = """case first_id % 7 when 1 then 'google' when 2 then 'bing' when 3 then 'yahoo'
  when 4 then 'duckduckgo' when 5 then 'google' end"""


@query(with_views(f"select page_load_id, {_ENGINE} as engine from fx_facts", PX, LOADS, FACTS))
def search_engine(spark, sf_dir):
    return pixel_sample.page_loads(spark, sf_dir).select(
        "page_load_id", urls.search_engine(F.col("referrer")).alias("engine")
    )


_DEVICE_SQL = """case first_id % 5 when 0 then 'Windows' when 1 then 'iOS' when 2 then 'Linux' end as os,
  case first_id % 5 when 0 then '10.0' when 1 then '17.' || cast(user_id % 4 as varchar) end as os_version,
  case first_id % 5 when 0 then 'Chrome' when 1 then 'Mobile Safari' when 2 then 'Firefox' end as browser,
  case first_id % 5 when 0 then '120.0.0.' || cast(user_id % 9 as varchar) when 1 then '17.0'
    when 2 then '12' || cast(user_id % 3 as varchar) || '.0' end as browser_version,
  case first_id % 5 when 1 then 'mobile' end as device_type"""


@query(with_views(f"select page_load_id, {_DEVICE_SQL} from fx_facts", PX, LOADS, FACTS))
def device_enrichment(spark, sf_dir):
    loads = page_context.with_device(pixel_sample.page_loads(spark, sf_dir))
    return loads.select("page_load_id", "device.*")


@query(with_views(f"select page_load_id, {_DEVICE_SQL} from fx_facts", PX, LOADS, FACTS))
def device_dictionary(spark, sf_dir):
    """The same by rules as rows and a dictionary of distinct agents."""
    loads = agents.with_agents(pixel_sample.page_loads(spark, sf_dir))
    return loads.select("page_load_id", "device.*")


@query(
    with_views(
        f"""
select page_load_id, {_DEVICE_SQL}, {_sql_host('href')} as host, {_sql_path('href')} as path,
  screen_height, screen_width, {_ENGINE} as engine, coalesce(nullif(referrer, ''), '$direct') as referrer,
  {_sql_param('href', 'utm_source')} as utm_source, {_sql_param('href', 'utm_source')} as initial_utm_source,
  href as initial_url, case when has_customer then customer_email end as set_email
from fx_facts where regexp_matches(href, '{_SCHEME}[^/?#]')
""",
        PX,
        LOADS,
        FACTS,
    )
)
def context_properties(spark, sf_dir):
    """The shared properties of page loads, read back from their JSON text."""
    contexts = page_context.page_contexts(pixel_sample.page_loads(spark, sf_dir))
    base = F.from_json(
        F.concat(F.lit("{"), F.col("context.base"), F.lit("}")),
        "`$os` string, `$os_version` string, `$browser` string, `$browser_version` string,"
        " `$device_type` string, `$host` string, `$pathname` string, `$screen_height` int,"
        " `$screen_width` int, `$search_engine` string, `$referrer` string, `$utm_source` string,"
        " `$set_once` struct<`$initial_utm_source`: string, `$initial_current_url`: string>",
    )
    names = {
        "$os": "os",
        "$os_version": "os_version",
        "$browser": "browser",
        "$browser_version": "browser_version",
        "$device_type": "device_type",
        "$host": "host",
        "$pathname": "path",
        "$screen_height": "screen_height",
        "$screen_width": "screen_width",
        "$search_engine": "engine",
        "$referrer": "referrer",
        "$utm_source": "utm_source",
    }
    read = contexts.select("page_load_id", base.alias("b"), F.col("context.person_set").alias("p"))
    return read.select(
        "page_load_id",
        *[F.col("b")[n].alias(a) for n, a in names.items()],
        F.col("b")["$set_once"]["$initial_utm_source"].alias("initial_utm_source"),
        F.col("b")["$set_once"]["$initial_current_url"].alias("initial_url"),
        F.get_json_object("p", "$.email").alias("set_email"),
    )


@query(
    with_views(
        "select event_id, page_load_id, loaded_us, load_href, anonymous from fx_sub", *VIEWS
    )
)
def event_context_join(spark, sf_dir):
    return _rows(spark, sf_dir).select(
        "event_id",
        "page_load_id",
        F.col("context.loaded_us").alias("loaded_us"),
        F.col("context.href").alias("load_href"),
        "anonymous",
    )


@query(
    with_views(
        """
select page_load_id, case flag_kind when 1 then '$feature/alpha,$feature/beta,$active_feature_flags'
    when 2 then '$feature/a_b,$feature/exp,$active_feature_flags' when 3 then '$feature/off' end as members,
  case flag_kind when 1 then 'beta' when 2 then 'a_b,exp' end as active,
  case flag_kind when 1 then 'false' end as alpha, case flag_kind when 2 then 'control' end as exp
from fx_facts
""",
        PX,
        LOADS,
        FACTS,
    )
)
def feature_flag_properties(spark, sf_dir):
    flags = F.col("feature_flags")
    text = F.concat(F.lit("{"), page_context.flag_members(flags), F.lit("}"))
    loads = pixel_sample.page_loads(spark, sf_dir).select(
        "page_load_id", text.alias("text"), page_context.active_flags(flags).alias("active")
    )
    return loads.select(
        "page_load_id",
        F.array_join(F.json_object_keys("text"), ",").alias("members"),
        F.array_join("active", ",").alias("active"),
        F.get_json_object("text", "$['$feature/alpha']").alias("alpha"),
        F.get_json_object("text", "$['$feature/exp']").alias("exp"),
    )


@query(with_views(f"select event_id, id, {_UUID} as uuid from fx_px", PX))
def event_uuid(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", "id", ids.event_uuid(F.col("id")).alias("uuid"))


@query(
    with_views(
        f"""
select {sample.shop_name('shop_no')} as shop, event_id, page_load_id from fx_px
where page_load_id not in (select page_load_id from fx_facts
  where regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]'))
""",
        PX,
        LOADS,
        FACTS,
    )
)
def orphan_events(spark, sf_dir):
    """Events without a working page load, which the pipeline leaves out."""
    orphans = page_context.orphan_events(_events(spark, sf_dir), pixel_sample.page_loads(spark, sf_dir))
    return orphans.select("shop", "event_id", "page_load_id")


# The whole table.

SUB_ROWS = (
    "fx_rows",
    state.ROWS[1].replace("from fx_px e join fx_contexts c using (page_load_id)", "from fx_sub e")
    .replace("c.shop, c.anonymous", "e.shop, e.anonymous"),
)
PIXEL_VIEWS = (*VIEWS, SUB_ROWS, state.LINE, *state._epoch_views(), state.IDENTITY)


def _pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.pixel_event_table(
        _events(spark, sf_dir),
        pixel_sample.page_loads(spark, sf_dir),
        sample.pixel_settings(spark, sf_dir),
    )


_NAMED = _EVENT.replace("case when spec_enabled then case name", "case when s.spec_enabled then case s.name").replace(
    "else name end else name end", "else s.name end else s.name end"
)
SESSION_VIEWS = (*state._session_views(bs.IDLE_US, bs.LENGTH_US), state.WINDOWS)


def _own(path: str) -> Column:
    """A property of a browser event, null on all others."""
    return F.when(F.col("properties").contains('"$window_id"'), _get(path))


@query(
    state._recursive(
        with_views(
            f"""
select s.event_id, s.shop, {_NAMED} as event, i.distinct_id, s.timestamp, {_UUID} as uuid,
  c.api_key, c.api_host, w.session_id, w.window_id, s.client_id,
  case when s.name in ('clicked', 'input_changed', 'form_submitted') then s.load_href else s.href end as current_url,
  {_sql_host('s.load_href')} as host, {_LOAD_QUANTITY} as load_quantity
from fx_sub s join fx_identity i using (event_id) join fx_window w using (event_id)
  join fx_shops c on c.shop = s.shop
""",
            *PIXEL_VIEWS,
            *SESSION_VIEWS,
        )
    )
)
def pixel_event_feed(spark, sf_dir):
    """The whole browser pipeline: gates, context, identity, sessions, properties."""
    return _pixel_table(spark, sf_dir).select(
        F.col("arrival_seq").alias("event_id"),
        "shop",
        "event",
        "distinct_id",
        "timestamp",
        "uuid",
        "api_key",
        "api_host",
        _get("$['$session_id']").alias("session_id"),
        _get("$['$window_id']").alias("window_id"),
        _get("$.client_id").alias("client_id"),
        _get("$['$current_url']").alias("current_url"),
        _get("$['$host']").alias("host"),
        _get("$.totalQuantity").cast("int").alias("load_quantity"),
    )


_IDENTIFY_SQL = """
select shop, '$identify' as event, to_id as distinct_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') as timestamp,
  cast(null as varchar) as uuid, from_id as ref, cast(null as varchar) as session_id
from (select shop, ts_us, distinct_id as from_id, post as to_id from fx_identity
    where is_event and post <> '' and post <> distinct_id
  union all select shop, ts_us, known, login from fx_known where not is_event and login <> '' and login <> known)
"""


@query(with_views(_IDENTIFY_SQL, *PIXEL_VIEWS, state.KNOWN))
def pixel_identify_events(spark, sf_dir):
    """The identify events that subscribed browser events and logins give rise to."""
    return _identify_table(spark, sf_dir).select(
        "shop",
        "event",
        "distinct_id",
        "timestamp",
        "uuid",
        _get("$['$anon_distinct_id']").alias("ref"),
        F.lit(None).cast("string").alias("session_id"),
    )


def _identify_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.pixel_identify_table(
        _events(spark, sf_dir),
        pixel_sample.page_loads(spark, sf_dir),
        sample.pixel_settings(spark, sf_dir),
    )


@query(
    state._recursive(
        with_views(
            f"""
select shop, event, distinct_id, timestamp, uuid, ref, cast(null as varchar) as session_id from fx_server_events
union all
select s.shop, {_NAMED} as event, i.distinct_id, s.timestamp, {_UUID} as uuid, null, w.session_id
from fx_sub s join fx_identity i using (event_id) join fx_window w using (event_id)
union all {_IDENTIFY_SQL}
""",
            *server.SERVER_VIEWS,
            *PIXEL_VIEWS[1:],
            state.KNOWN,
            *SESSION_VIEWS,
        )
    )
)
def all_channel_events(spark, sf_dir):
    """Server events, browser events and browser identifies in one table, retries removed."""
    feeds = envelope.all_events(
        server.server_event_table(spark, sf_dir),
        _pixel_table(spark, sf_dir),
        _identify_table(spark, sf_dir),
    )
    unique = dedup.deduplicated(land(feeds))
    session = _own("$['$session_id']")
    ref = F.coalesce(_get("$['$anon_distinct_id']"), server._reference())
    return unique.select(
        "shop",
        "event",
        "distinct_id",
        "timestamp",
        "uuid",
        F.when(session.isNull(), ref).alias("ref"),
        session.alias("session_id"),
    )


@query(
    with_views(
        f"""
select url, api_key, (place - 1) // 10 as batch_no, count(*) as size,
  string_agg(event || ' ' || distinct_id, ',' order by place) as listed from (
  select regexp_replace(c.api_host, '/$', '') || '/batch/' as url, c.api_key, {_NAMED} as event, i.distinct_id,
    row_number() over (partition by c.api_host, c.api_key order by s.timestamp, s.event_id) as place
  from fx_sub s join fx_identity i using (event_id) join fx_shops c on c.shop = s.shop) group by 1, 2, 3
""",
        *PIXEL_VIEWS,
    )
)
def pixel_requests(spark, sf_dir):
    """Browser events as request bodies, read back: ten to a request per host and key, in order."""
    # Hot keys are counted, sampled and cut apart: without this every step would make the bodies anew.
    sent = land(envelope.enveloped(envelope.all_events(_pixel_table(spark, sf_dir))))
    numbered = envelope.numbered_batches(
        sent, ["url", "api_key"], ["timestamp", "arrival_seq"], hot_rows=2000, slice_rows=1000
    )
    body = "struct<api_key: string, batch: array<struct<event: string, distinct_id: string,"
    body += " properties: struct<distinct_id: string>>>>"
    read = envelope.batch_requests(numbered).select(
        "url", "batch_no", F.from_json("request", body).alias("r")
    )
    names = F.transform("r.batch", lambda e: F.concat_ws(" ", e["event"], e["properties"]["distinct_id"]))
    return read.select(
        "url",
        "r.api_key",
        "batch_no",
        F.size("r.batch").cast("long").alias("size"),
        F.array_join(names, ",").alias("listed"),
    )
