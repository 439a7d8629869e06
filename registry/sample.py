"""Payloads derived from the given tables, and the same data for the SQL oracle.

Flat rows are one SQL text that Spark and DuckDB both run; Spark then nests them
into the payload shapes and lands them as Parquet in the shared folder, once per
application and source folder, as a collector would. The numbers decide which
edge cases a row carries. A third of the customers and of the browsing users
belong to shop 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storewake.session import shared_folder

ROWS_PER_FILE = 250_000
# Landed texts repeat names and values; this codec finds what the default one does not.
CODEC = "zstd"
TABLES = ("supplier", "customer", "orders", "lineitem", "part", "events", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used, **frames)


_landed: dict[tuple[str, str, str], tuple[str, object]] = {}


def landed(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    last: Callable[[DataFrame], DataFrame] | None = None,
    spread: bool = True,
) -> DataFrame:
    """The built table, written on first use and read from there afterwards.

    `last` makes rows that are appended in a later file, so that a stream over
    the files meets them at the end. Narrow rows are spread over files by their number; wide ones
    (`spread` is false) are written where they are made, without another exchange.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        source = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
        path = f"{shared_folder(spark)}/landed/{key[0]}/{source}/{name}"
        frame = build(spark, sf_dir)
        if spread:
            files = max(spark.sparkContext.defaultParallelism, frame.count() // ROWS_PER_FILE)
            frame = frame.repartition(files)
        frame.write.mode("overwrite").parquet(path, compression=CODEC)
        if last is not None:
            written = spark.read.schema(frame.schema).parquet(path)
            last(written).select(*frame.columns).coalesce(1).write.mode("append").parquet(path, compression=CODEC)
        _landed[key] = (path, frame.schema)
    path, schema = _landed[key]
    return spark.read.schema(schema).parquet(path)


def shop_name(number: str) -> str:
    return (
        f"'shop' || cast({number} as string) || case when {number} % 25 = 24"
        " then '.example.com' else '.myshopify.com' end"
    )


def _money(number: str) -> str:
    return f"cast(cast({number} as decimal(18,2)) as string)"


def _date(col: str, time: str) -> str:
    return f"substr(cast({col} as string), 1, 10) || 'T{time}Z'"


SHOPS = f"""
select s_suppkey as shop_no,
  {shop_name('s_suppkey')} as shop,
  case when s_suppkey % 9 = 8 then null when s_suppkey % 9 = 7 then ''
    else 'phc_' || md5(cast(s_suppkey as string)) end as api_key,
  case when s_suppkey % 10 = 9 then null
    else 'https://eu' || cast(s_suppkey % 3 as string) || '.example.com'
      || case when s_suppkey % 2 = 0 then '/' else '' end end as api_host,
  case s_suppkey % 4 when 0 then 'non-anonymized' when 1 then 'anonymized'
    when 2 then 'non-anonymized-by-consent' else 'bogus' end as strategy,
  s_suppkey % 5 <> 4 as server_enabled,
  case s_suppkey % 8 when 5 then '[]' when 6 then 'not json' when 7 then chr(123) || chr(125)
    when 0 then '["page_viewed","collection_viewed","product_viewed","search_submitted","clicked","product_added_to_cart","product_removed_from_cart","cart_viewed","form_submitted","checkout_started","checkout_completed","checkout_contact_info_submitted","checkout_address_info_submitted","checkout_shipping_info_submitted","payment_info_submitted","input_changed"]'
    when 1 then '["page_viewed","checkout_completed","input_changed"]'
    when 2 then '["page_viewed","product_viewed","cart_viewed","form_submitted","checkout_started"]'
    when 3 then null
    else '["clicked","page_viewed","collection_viewed"]' end as tracked_events,
  case when s_suppkey % 3 = 1 then 'true' else 'false' end as on_checkout,
  case when s_suppkey % 3 = 2 then 'true' when s_suppkey % 7 = 3 then 'false' end as on_page,
  case when s_suppkey % 6 = 4 then 'false' end as on_search,
  case when s_suppkey % 5 <> 3 then 'true' else 'false' end as spec
from {{supplier}}
"""

ORDER_SOURCE = "from {orders} o join {customer} c on o.o_custkey = c.c_custkey"
ORDER_HEADS = f"""
select o.o_orderkey as id, c.c_custkey as cust,
  case when c.c_custkey % 3 = 0 then 0 else c.c_custkey % (n.shops + 3) end as shop_no,
  case o.o_orderkey % 5 when 0 then null when 1 then 'null'
    else 'buyer' || cast(c.c_custkey as string) || '@example.com' end as email,
  {_date('o.o_orderdate', '00:00:00')} as created_at,
  case when o.o_orderkey % 13 <> 0 then {_date('o.o_orderdate', '12:00:00')} end as updated_at,
  case when o.o_orderkey % 31 = 0 then 0 else o.o_orderkey + 1000 end as order_number,
  case when o.o_orderkey % 37 = 0 then '' else '#' || cast(o.o_orderkey as string) end as name,
  case when o.o_orderkey % 6 <> 5 then md5(cast(o.o_orderkey as string)) end as checkout_token,
  case when o.o_orderkey % 41 = 0 then '' when o.o_orderkey % 2 = 0 then 'USD' else 'EUR' end as currency,
  case o.o_orderkey % 4 when 0 then 'web' when 1 then 'pos' when 2 then 'subscription_contract' end as source_name,
  case when o.o_orderkey % 17 = 0 then 'abc' when o.o_orderkey % 19 = 0 then '0.00'
    when o.o_orderkey % 23 = 0 then '12.5kg' when o.o_orderkey % 29 = 0 then null
    when o.o_orderkey % 43 = 0 then ''
    else {_money('o.o_totalprice')} end as total_price,
  {_money('o.o_totalprice')} as subtotal_price,
  cast(o.o_orderkey % 100 as string) || '.5' as total_tax,
  case when o.o_orderkey % 7 = 0 then '0.00' else cast(o.o_orderkey % 9 as string) || '.25' end as total_discounts,
  case when o.o_orderkey % 3 <> 0 then cast(o.o_orderkey % 20 as string) || '.50' end as shipping_amount,
  case o.o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else '' end as financial_status,
  case when o.o_orderkey % 3 = 1 then 'fulfilled' end as fulfillment_status,
  o.o_orderkey % 7 as gateway_kind,
  case when o.o_orderkey % 2 = 0 then '' else 'vip' end as tags,
  case when o.o_orderkey % 3 = 0 then '' else 'https://ref.example.com/' end as referring_site,
  case when o.o_orderkey % 5 = 0 then null else '/landing' end as landing_site,
  case when o.o_orderkey % 2 = 0 then 'USD' end as presentment_currency,
  o.o_orderstatus as status,
  case when o.o_orderkey % 3 = 0 then 'customer' else '' end as cancel_reason,
  case when o.o_orderkey % 2 <> 0 then {_date('o.o_orderdate', '18:00:00')} end as cancelled_at,
  o.o_orderkey % 5 as code_kind,
  c.c_custkey % 17 <> 0 as has_customer,
  case when c.c_custkey % 11 <> 0 then c.c_custkey end as customer_id,
  case c.c_custkey % 7 when 0 then null when 1 then ' Guest '
    when 2 then '  CUST' || cast(c.c_custkey as string) || '@Example.COM '
    else 'cust' || cast(c.c_custkey as string) || '@example.com' end as customer_email,
  case when c.c_custkey % 5 = 0 then '' else 'First' || cast(c.c_custkey as string) end as first_name,
  case when c.c_custkey % 6 <> 0 then 'Last' || cast(c.c_custkey as string) end as last_name,
  case when c.c_custkey % 4 = 0 then '+1555' || cast(c.c_custkey as string) end as phone,
  case when c.c_custkey % 4 <> 3 then cast(c.c_custkey % 4 as int) end as orders_count,
  case c.c_custkey % 3 when 0 then '' when 2 then {_money('c.c_acctbal')} end as total_spent,
  case when c.c_custkey % 2 = 0 then '' else 'loyal' end as customer_tags,
  c.c_custkey % 4 <> 0 as has_address,
  case when c.c_custkey % 6 = 0 then '' else 'City' || cast(c.c_custkey % 50 as string) end as city,
  'Country' || cast(c.c_nationkey as string) as country,
  case when c.c_custkey % 9 <> 0 then 'C' || cast(c.c_nationkey as string) end as country_code,
  o.o_orderkey % 8 <> 0 as has_billing,
  case when c.c_custkey % 8 = 1 then 'open' when c.c_custkey % 8 = 2 then '' else 'enabled' end as state
{ORDER_SOURCE}
  join (select count(*) as shops, 1 as one from {{supplier}}) n on n.one = 1
"""

LINE_SOURCE = "from {lineitem} join {part} on l_partkey = p_partkey"
LINES = f"""
select l_orderkey as order_id, l_linenumber as line_no, l_partkey as part, l_suppkey as supp,
  l_extendedprice as ext, l_quantity as qty, l_returnflag as flag,
  l_partkey * 10 + l_linenumber as line_id,
  case when l_partkey % 13 = 0 then 0 when l_partkey % 13 = 1 then null else l_partkey end as product_id,
  l_partkey * 100 + l_suppkey as variant_id,
  case when l_partkey % 10 = 0 then '' else 'SKU' || cast(l_partkey as string) end as sku,
  p_name as title,
  case when l_partkey % 9 = 0 then '' else p_type end as variant_title,
  case when l_partkey % 15 = 0 then null else p_brand end as vendor,
  case when l_linenumber = 7 then 0 else cast(l_quantity as int) end as quantity,
  case when l_partkey % 29 = 0 then 'abc' else {_money('l_extendedprice')} end as price,
  l_discount > 0.05 as discounted,
  case when l_orderkey % 50 = 0 then '0.00'
    when l_linenumber % 3 = 0 then null
    when l_linenumber % 3 = 1 and l_partkey % 7 = 0 then 'abc'
    else {_money('l_extendedprice')} end as amount,
  case when l_orderkey % 50 = 0 then cast(0 as double) else l_quantity end as subtotal
{LINE_SOURCE}
"""

LINE_ORDER = ("line_no", "part", "supp", "ext", "qty")

CUSTOMERS = f"""
select c_custkey as id,
  case when c_custkey % 3 = 0 then 0 else c_custkey % (n.shops + 3) end as shop_no,
  case c_custkey % 7 when 0 then null when 1 then ' Guest '
    when 2 then '  CUST' || cast(c_custkey as string) || '@Example.COM '
    else 'cust' || cast(c_custkey as string) || '@example.com' end as email,
  case when c_custkey % 5 = 0 then '' else 'First' || cast(c_custkey as string) end as first_name,
  case when c_custkey % 6 <> 0 then 'Last' || cast(c_custkey as string) end as last_name,
  case when c_custkey % 4 = 0 then '+1555' || cast(c_custkey as string) end as phone,
  case when c_custkey % 4 <> 3 then cast(c_custkey % 4 as int) end as orders_count,
  case c_custkey % 3 when 0 then '' when 2 then {_money('c_acctbal')} end as total_spent,
  case when c_custkey % 2 = 0 then '' else 'loyal' end as tags,
  case when c_custkey % 8 = 1 then 'invited' when c_custkey % 8 = 2 then '' else 'enabled' end as state,
  c_custkey % 4 <> 0 as has_address,
  case when c_custkey % 6 = 0 then '' else 'City' || cast(c_custkey % 50 as string) end as city,
  'Country' || cast(c_nationkey as string) as country,
  case when c_custkey % 9 <> 0 then 'C' || cast(c_nationkey as string) end as country_code,
  '20' || lpad(cast(c_custkey % 24 as string), 2, '0') || '-01-01T00:00:00Z' as created_at,
  '2024-02-' || lpad(cast(c_custkey % 28 + 1 as string), 2, '0') || 'T00:00:00Z' as updated_at
from {{customer}} join (select count(*) as shops, 1 as one from {{supplier}}) n on n.one = 1
"""

REFUND_HEADS = """
select o.o_orderkey + 5000000 as id, o.o_orderkey as order_id, c.c_custkey as cust,
  case when c.c_custkey % 3 = 0 then 0 else c.c_custkey % (n.shops + 3) end as shop_no,
  substr(cast(o.o_orderdate as string), 1, 10) || 'T20:00:00Z' as created_at,
  case when o.o_orderkey % 3 = 0 then '' else 'damaged' end as note,
  case when o.o_orderkey % 4 = 0 then ' Ref' || cast(c.c_custkey as string) || '@Example.com' end as customer_email,
  case when o.o_orderkey % 4 = 1 then 'guest' when o.o_orderkey % 4 = 0 then 'other@example.com' end as order_email,
  case when o.o_orderkey % 4 = 2 then 'top' || cast(c.c_custkey as string) || '@example.com'
    when o.o_orderkey % 4 = 3 then '' end as email
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
  join (select count(*) as shops, 1 as one from {supplier}) n on n.one = 1
where exists (select 1 from {lineitem} where l_orderkey = o.o_orderkey and l_returnflag = 'R')
"""


def with_shop_name(rows: DataFrame, keep: bool = False) -> DataFrame:
    named = rows.withColumn("shop", F.expr(shop_name("shop_no")))
    return named if keep else named.drop("shop_no")


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "shops", _shops)


def _shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, SHOPS).select(
        "shop", "api_key", "api_host", "strategy", "server_enabled"
    )


def pixel_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "pixel_settings", _pixel_settings)


def _pixel_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {
        "checkout_started": "on_checkout",
        "checkout_completed": "on_checkout",
        "page_viewed": "on_page",
        "search_submitted": "on_search",
    }
    pairs = [c for n, v in names.items() for c in (F.lit(n), F.col(v))]
    switches = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return run_sql(spark, sf_dir, SHOPS).select(
        "shop",
        "api_key",
        "api_host",
        "strategy",
        "tracked_events",
        "spec",
        switches.alias("switches"),
    )


def _address(has: str) -> Column:
    address = F.struct("city", F.lit(None).cast("string").alias("province"), "country", "country_code")
    return F.when(F.col(has), address)


def _shop_money(amount: str) -> Column:
    money = F.struct(F.col(amount).alias("amount"), F.lit("USD").alias("currency_code"))
    return F.struct(money.alias("shop_money"))


def _lines(spark: SparkSession, sf_dir: str, where: str = "") -> DataFrame:
    """The rows of LINES, those of an order together: the given columns travel, texts are made where they land."""
    given = "select {lineitem}.*, p_name, p_type, p_brand " + LINE_SOURCE + where
    together = run_sql(spark, sf_dir, given).repartition("l_orderkey")
    return spark.sql(LINES.replace(LINE_SOURCE, "from {together}"), together=together)


def _nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as one array per order, in line order."""
    none = F.lit(None).cast("string")
    allocation = F.struct(F.lit("1.00").alias("amount"), F.lit(0).alias("discount_application_index"))
    no_allocation = F.array().cast("array<struct<amount: string, discount_application_index: int>>")
    line = F.struct(
        F.col("line_id").alias("id"),
        "product_id",
        "variant_id",
        "sku",
        "title",
        "variant_title",
        "vendor",
        "quantity",
        "price",
        none.alias("total_discount"),
        F.when(F.col("discounted"), F.array(allocation))
        .otherwise(no_allocation)
        .alias("discount_allocations"),
        F.lit(True).alias("product_exists"),
    )
    entry = F.struct(*LINE_ORDER, line.alias("line"))
    return (
        _lines(spark, sf_dir)
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            F.col("order_id").alias("id"),
            F.transform("entries", lambda e: e["line"]).alias("line_items"),
        )
    )


def orders(spark: SparkSession, sf_dir: str, retries: bool = False) -> DataFrame:
    """Order payloads. Retries: every tenth order arrives twice."""
    out = landed(spark, sf_dir, "orders", _orders, spread=False)
    if retries:
        last = F.when(F.col("id") % 10 == 0, 1).otherwise(0).cast("long")
        out = out.withColumn("arrival_seq", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders meet their lines with the given columns only; the texts of the heads are made after the join.
    given = "select struct(o.*) as o, struct(c.*) as c, o.o_orderkey as id " + ORDER_SOURCE
    pairs = run_sql(spark, sf_dir, given).join(_nested_lines(spark, sf_dir), "id", "left").drop("id")
    text = ORDER_HEADS.replace(ORDER_SOURCE, "from {pairs}").replace("select ", "select line_items, ", 1)
    heads = with_shop_name(run_sql(spark, sf_dir, text, pairs=pairs))
    none = F.lit(None).cast("string")

    def code(text: Column) -> Column:
        return F.struct(text.alias("code"), F.lit("1.00").alias("amount"), F.lit("fixed").alias("type"))

    codes = (
        F.when(F.col("code_kind") == 1, F.array().cast("array<struct<code: string, amount: string, type: string>>"))
        .when(F.col("code_kind") == 2, F.array(code(F.lit("SAVE"))))
        .when(F.col("code_kind") == 3, F.array(code(F.lit("A")), code(F.lit("B"))))
        .when(F.col("code_kind") == 4, F.array(code(none)))
    )
    gateways = F.when(F.col("gateway_kind") == 1, F.array().cast("array<string>")).when(
        F.col("gateway_kind") > 1, F.array(F.lit("manual"), F.lit("card"))
    )
    customer = F.when(
        F.col("has_customer"),
        F.struct(
            F.col("customer_id").alias("id"),
            F.col("customer_email").alias("email"),
            "first_name",
            "last_name",
            "phone",
            "orders_count",
            "total_spent",
            F.col("customer_tags").alias("tags"),
            _address("has_address").alias("default_address"),
        ),
    )
    return heads.select(
        "shop",
        F.lit(0).cast("long").alias("arrival_seq"),
        "id",
        "email",
        "created_at",
        "updated_at",
        "order_number",
        "name",
        "checkout_token",
        "currency",
        "source_name",
        "total_price",
        "subtotal_price",
        "total_tax",
        "total_discounts",
        F.when(F.col("shipping_amount").isNotNull(), _shop_money("shipping_amount")).alias(
            "total_shipping_price_set"
        ),
        codes.alias("discount_codes"),
        "line_items",
        "financial_status",
        "fulfillment_status",
        gateways.alias("payment_gateway_names"),
        "tags",
        "referring_site",
        "landing_site",
        "presentment_currency",
        "cancel_reason",
        "cancelled_at",
        customer.alias("customer"),
        _address("has_billing").alias("billing_address"),
        "status",
    )


def cancelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where(F.col("status") == "F")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "customers", _customers)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = with_shop_name(run_sql(spark, sf_dir, CUSTOMERS))
    return flat.select(
        "shop",
        F.lit(0).cast("long").alias("arrival_seq"),
        "id",
        "email",
        "first_name",
        "last_name",
        "phone",
        "orders_count",
        "total_spent",
        "tags",
        "state",
        F.lit(True).alias("verified_email"),
        _address("has_address").alias("default_address"),
        "created_at",
        "updated_at",
    )


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "refunds", _refunds, spread=False)


def _refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = with_shop_name(run_sql(spark, sf_dir, REFUND_HEADS))
    item = F.struct(
        F.col("line_id").alias("id"),
        "product_id",
        "variant_id",
        "sku",
        "title",
        "variant_title",
        "vendor",
        "price",
        "quantity",
    )
    line = F.struct(
        F.col("line_id").alias("id"),
        F.col("line_id").alias("line_item_id"),
        "quantity",
        "subtotal",
        _shop_money("amount").alias("subtotal_set"),
        F.lit(0.0).alias("total_tax"),
        item.alias("line_item"),
    )
    nested = (
        _lines(spark, sf_dir, " where l_returnflag = 'R'")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(F.struct(*LINE_ORDER, line.alias("line")))).alias("e"))
        .select("order_id", F.transform("e", lambda x: x["line"]).alias("refund_line_items"))
    )
    heads = heads.join(nested, "order_id", "left")
    return heads.select(
        "shop",
        F.lit(0).cast("long").alias("arrival_seq"),
        "id",
        "order_id",
        "created_at",
        "note",
        "email",
        F.when(
            F.col("customer_email").isNotNull(), F.struct(F.col("customer_email").alias("email"))
        ).alias("customer"),
        F.when(
            F.col("order_email").isNotNull(), F.struct(F.col("order_email").alias("email"))
        ).alias("order"),
        "refund_line_items",
    )


def view(name: str, text: str) -> tuple[str, str]:
    return name, text.format(**{t: t for t in TABLES})


def with_views(select: str, *views: tuple[str, str]) -> str:
    """An oracle query over the given views."""
    ctes = ",\n".join(f"{name} as ({text.strip()})" for name, text in views)
    return f"with {ctes}\n{select.strip()}"
