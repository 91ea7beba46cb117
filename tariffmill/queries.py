"""Registered queries of the engine's own operators over the driver's tables, with their SQL.

Correspondence: a supplier is a clinic (and its one branch, in its nation as city), a part is a
service with its brand as category and its type as canonical name, and a line item is a price
observation with its return flag as currency; it is available while its status is O.  Money
leaves as double and dates as text, so both engines give one type.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules
from .functions import text as X
from .functions import vocab
from .operators import match, state, upsert, validate, workflow
from .operators.lake import CODEC, Lake
from .plans import ingest, quality
from .plans import star as S
from .session import shared_dir, shuffles_removed
from .sources import documents
from .sources.payloads import ROW
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW, NOW_TEXT = "2001-11-05", "DATE '2001-11-05'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("clinic_id"),
        F.col("l_suppkey").alias("branch_id"),
        F.col("l_partkey").alias("service_id"),
        F.col("l_returnflag").alias("currency"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_shipdate").cast("date").alias("observed_at"),
        (F.col("l_linestatus") == "O").alias("is_available"),
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("row_index"),
    )


ORDER = ["observed_at", "batch_id", "row_index", "price"]
OBS = """obs AS (SELECT l_suppkey AS clinic_id, l_partkey AS service_id, l_returnflag AS currency, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  CAST(l_shipdate AS DATE) AS observed_at, l_linestatus = 'O' AS is_available, l_orderkey AS batch_id, l_linenumber AS row_index FROM lineitem)"""
CUR = OBS + """, cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY clinic_id, service_id, currency
  ORDER BY observed_at DESC, batch_id DESC, row_index DESC, price DESC, is_available DESC) AS rn FROM obs) WHERE rn = 1)"""
STAR = CUR + """, star AS (SELECT cur.*, p_name AS service_name, p_brand AS category, p_type AS canonical_name, s_name AS clinic_name, n_name AS city, r_name AS region
  FROM cur JOIN part ON p_partkey = service_id JOIN supplier ON s_suppkey = clinic_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
CHANGES = OBS + """, changes AS (SELECT *, lag(price) OVER w AS old_price, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN lag(price) OVER w = price THEN 'unchanged' ELSE 'updated' END AS status
  FROM obs WINDOW w AS (PARTITION BY clinic_id, service_id, currency ORDER BY observed_at, batch_id, row_index, price))"""
FRESH = "CASE WHEN age_days <= 30 THEN 'fresh' WHEN age_days <= 90 THEN 'stale' ELSE 'expired' END"


def mean_sql(x: str) -> str:
    """A mean to cents with ties to even, in whole cents."""
    s, n = f"CAST(sum({x}) * 100 AS BIGINT)", f"count({x})"
    return f"CAST(({s} // {n} + CASE WHEN 2 * ({s} % {n}) > {n} OR (2 * ({s} % {n}) = {n} AND ({s} // {n}) % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE) / 100"


_STORED: dict[tuple, str] = {}


def stored_current(spark: SparkSession, d: str) -> DataFrame:
    """The current prices as a stored table, as imports keep them: made from the log once in a session, and anew if the log's files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/lineitem.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, d, files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime())
    if key not in _STORED:
        made = f"{shared_dir(spark)}/current-{uuid.uuid4().hex}"
        state.latest(observations(spark, d), ORDER).write.parquet(made)
        _STORED[key] = made
    return spark.read.parquet(_STORED[key])


def star(spark: SparkSession, d: str) -> S.Star:
    yes = F.lit(True)
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return S.Star(
        stored_current(spark, d),
        table(spark, d, "part").select(F.col("p_partkey").alias("service_id"), F.col("p_name").alias("service_name"), F.col("p_brand").alias("category"), F.col("p_type").alias("canonical_name"), yes.alias("service_active")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("clinic_id"), F.col("s_name").alias("clinic_name"), yes.alias("clinic_active")),
        places.select(F.col("s_suppkey").alias("branch_id"), F.col("n_name").alias("city"), F.col("r_name").alias("region"), yes.alias("branch_active")),
    )


def money(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as text, truth as 0 or 1, small integers as long."""
    out = []
    for c, kind in df.dtypes:
        cast = "double" if kind.startswith("decimal") else "string" if kind == "date" else "int" if kind == "boolean" else "bigint" if kind == "int" else None
        out.append(F.col(f"`{c}`").cast(cast).alias(c) if cast else F.col(f"`{c}`"))
    return df.select(*out)


now = lambda: F.lit(NOW).cast("date")
STATS = f"CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {mean_sql('price')} AS average_price, count(*) AS \"count\""
PAGE = "clinic_id, service_id, currency, CAST(price AS DOUBLE) AS price, CAST(observed_at AS VARCHAR) AS observed_at, service_name, clinic_name, city"
PAGE_COLUMNS = ("clinic_id", "service_id", "currency", "price", "observed_at", "service_name", "clinic_name", "city")


# -- comparison and search


@query(f"WITH {STAR} SELECT category, {STATS}, sum(CASE WHEN date_diff('day', observed_at, {NOW_TEXT}) <= 30 THEN 1 ELSE 0 END)::BIGINT AS fresh FROM star WHERE is_available AND service_name LIKE '%ring%' GROUP BY category")
def compare_prices(spark: SparkSession, d: str) -> DataFrame:
    rows = S.with_freshness(S.filtered(star(spark, d), q="ring"), now())
    return money(S.price_stats(rows, "category", more=(F.count_if(F.col("freshness") == "fresh").alias("fresh"),)))


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE is_available AND (service_name LIKE '%bolt%' OR lower(canonical_name) LIKE '%bolt%' OR lower(category) LIKE '%bolt%' OR lower(clinic_name) LIKE '%bolt%') AND lower(city) LIKE '%nation_3%' ORDER BY star.price, clinic_name, clinic_id, service_id, currency LIMIT 50")
def compare_items_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = S.filtered(star(spark, d), q="bolt", city="NATION_3")
    return money(S.ordered(rows, "price_asc", "clinic_name").limit(50).select(*PAGE_COLUMNS))


SEARCH = "is_available AND (service_name LIKE '%ing%' OR lower(canonical_name) LIKE '%ing%' OR lower(category) LIKE '%ing%' OR lower(clinic_name) LIKE '%ing%') AND star.price >= 20000 AND star.price <= 60000"


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE {SEARCH} ORDER BY service_name, star.price, clinic_id, service_id, currency LIMIT 20 OFFSET 40")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    return money(S.search(star(spark, d), "ing", limit=20, offset=40, low=20000, high=60000).select(*PAGE_COLUMNS))


@query(f"WITH {STAR} SELECT count(*) AS total FROM star WHERE {SEARCH}")
def search_total(spark: SparkSession, d: str) -> DataFrame:
    return S.filtered(star(spark, d), "ing", low=20000, high=60000).agg(F.count("*").alias("total"))


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE is_available AND (service_name LIKE '%bolt%' OR lower(canonical_name) LIKE '%bolt%' OR lower(category) LIKE '%bolt%' OR lower(clinic_name) LIKE '%bolt%') AND lower(city) LIKE '%nation_1%' AND lower(category) = 'brand#11' ORDER BY star.price DESC, service_name, clinic_id, service_id, currency LIMIT 100")
def search_city_category(spark: SparkSession, d: str) -> DataFrame:
    return money(S.search(star(spark, d), "bolt", "price_desc", 100, city="NATION_1", category="Brand#11").select(*PAGE_COLUMNS))


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE {SEARCH} ORDER BY star.observed_at DESC, service_name, clinic_id, service_id, currency LIMIT 30")
def search_sort_updated(spark: SparkSession, d: str) -> DataFrame:
    return money(S.search(star(spark, d), "ing", "updated_desc", 30, low=20000, high=60000).select(*PAGE_COLUMNS))


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE {SEARCH} ORDER BY star.price DESC, service_name, clinic_id, service_id, currency LIMIT 30")
def search_sort_price_desc(spark: SparkSession, d: str) -> DataFrame:
    return money(S.search(star(spark, d), "ing", "price_desc", 30, low=20000, high=60000).select(*PAGE_COLUMNS))


@query(f"WITH {CUR} SELECT {STATS} FROM cur WHERE service_id = 7")
def service_detail_stats(spark: SparkSession, d: str) -> DataFrame:
    return money(S.price_stats(S.service_detail(star(spark, d), 7)))


@query("SELECT p_brand AS category, count(DISTINCT p_partkey) AS service_count FROM part GROUP BY 1")
def categories_count(spark: SparkSession, d: str) -> DataFrame:
    return S.categories(star(spark, d))


@query(f"WITH {CUR}, priced AS (SELECT DISTINCT clinic_id FROM cur WHERE is_available) SELECT n_name AS city, count(DISTINCT s_suppkey) AS branch_count, count(clinic_id) AS priced_count FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN priced ON clinic_id = s_suppkey GROUP BY 1")
def cities_count(spark: SparkSession, d: str) -> DataFrame:
    return S.cities(star(spark, d))


@query(f"WITH {STAR}, agg AS (SELECT clinic_id, count(DISTINCT service_id) AS service_count, count(DISTINCT clinic_id) AS branch_count, max(observed_at) AS last_updated FROM cur GROUP BY 1) SELECT s_suppkey AS clinic_id, s_name AS clinic_name, coalesce(service_count, 0) AS service_count, coalesce(branch_count, 0) AS branch_count, CAST(last_updated AS VARCHAR) AS last_updated FROM supplier LEFT JOIN agg ON clinic_id = s_suppkey WHERE s_suppkey IN (SELECT clinic_id FROM star WHERE category = 'Brand#12')")
def clinics_list(spark: SparkSession, d: str) -> DataFrame:
    return money(S.clinics(star(spark, d), category="Brand#12").drop("clinic_active"))


@query(f"WITH {CUR}, agg AS (SELECT clinic_id, count(DISTINCT service_id) AS service_count, count(DISTINCT clinic_id) AS branch_count, max(observed_at) AS last_updated FROM cur GROUP BY 1) SELECT s_suppkey AS clinic_id, s_name AS clinic_name, service_count, branch_count, CAST(last_updated AS VARCHAR) AS last_updated FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN agg ON clinic_id = s_suppkey WHERE lower(n_name) = 'nation_3'")
def clinics_in_city(spark: SparkSession, d: str) -> DataFrame:
    """The clinic list of one city, meant exactly: cities whose names begin alike stay out."""
    return money(S.clinics(star(spark, d), city="Nation_3").drop("clinic_active"))


@query("SELECT category, count(p_partkey) AS service_count FROM (SELECT p_brand AS category FROM part UNION SELECT p_type FROM part) LEFT JOIN part ON p_brand = category GROUP BY 1")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """A category table of all brands and types, of which types hold no service."""
    p = table(spark, d, "part")
    listed = p.select(F.col("p_brand").alias("category")).union(p.select("p_type")).distinct()
    return S.category_counts(listed, star(spark, d).services)


@query("SELECT s_suppkey AS branch_id, s_nationkey AS clinic_id, CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS is_default, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 9 = 0 DESC, s_suppkey) AS place FROM supplier")
def branches_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Branches of each clinic with their place, default ones first."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("branch_id"), F.col("s_nationkey").alias("clinic_id"), (F.col("s_suppkey") % 9 == 0).alias("is_default"))
    ordered = S.branches_of(s).withColumn("at", F.monotonically_increasing_id())  # grows along the order of the rows
    return money(ordered.withColumn("place", F.row_number().over(Window.partitionBy("clinic_id").orderBy("at"))).drop("at"))


@query(f"WITH {CUR} SELECT service_id, p_name AS service_name, p_brand AS category, currency, CAST(price AS DOUBLE) AS price FROM cur JOIN part ON p_partkey = service_id WHERE clinic_id = 5")
def clinic_detail(spark: SparkSession, d: str) -> DataFrame:
    return money(S.clinic_detail(star(spark, d), 5).select("service_id", "service_name", "category", "currency", "price"))


@query(f"WITH {STAR} SELECT coalesce(region, 'ALL') AS region, coalesce(city, 'ALL') AS city, count(*) AS \"count\", CAST(min(price) AS DOUBLE) AS min_price FROM star WHERE is_available GROUP BY ROLLUP (star.region, star.city)")
def regions_rollup(spark: SparkSession, d: str) -> DataFrame:
    return money(S.rollup_regions(star(spark, d)).na.fill("ALL", ["region", "city"]))


# -- state


@query(f"WITH {CUR} SELECT clinic_id, service_id, currency, CAST(price AS DOUBLE) AS price, CAST(observed_at AS VARCHAR) AS observed_at, batch_id FROM cur")
def current_price(spark: SparkSession, d: str) -> DataFrame:
    return money(state.latest(observations(spark, d), ORDER).select("clinic_id", "service_id", "currency", "price", "observed_at", "batch_id"))


@query(f"WITH {CHANGES} SELECT status, count(*) AS n, coalesce(CAST(sum(price - old_price) AS DOUBLE), 0) AS drift FROM changes GROUP BY 1")
def price_change_status(spark: SparkSession, d: str) -> DataFrame:
    changes = state.with_change(observations(spark, d), ORDER)
    return money(changes.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("price") - F.col("old_price")).cast("double"), F.lit(0.0)).alias("drift")))


COARSE = CHANGES.replace("CAST(l_extendedprice AS DECIMAL(12,2)) AS price", "CAST(floor(l_extendedprice / 30000) AS BIGINT) AS price")


@query(f"WITH {COARSE} SELECT status, count(*) AS n FROM changes GROUP BY 1")
def price_change_coarse(spark: SparkSession, d: str) -> DataFrame:
    """Prices in steps, so that unchanged ones occur."""
    rows = observations(spark, d).withColumn("price", F.floor(F.col("price").cast("double") / 30000))
    return state.with_change(rows, ORDER).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {CHANGES} SELECT batch_id, row_index, clinic_id, service_id, currency, CAST(price AS DOUBLE) AS price, coalesce(CAST(old_price AS DOUBLE), -1) AS old_price, status FROM changes WHERE status = 'updated'")
def price_history(spark: SparkSession, d: str) -> DataFrame:
    rows = state.history(state.with_change(observations(spark, d), ORDER)).where("status = 'updated'")
    return money(rows.select("batch_id", "row_index", "clinic_id", "service_id", "currency", "price", "old_price", "status")).na.fill(-1.0, ["old_price"])


@query(f"WITH {COARSE} SELECT CASE WHEN status <> 'unchanged' THEN 1 ELSE 0 END AS change_detected, count(*) AS n, CAST(min(observed_at) AS VARCHAR) AS first_at FROM changes GROUP BY 1")
def price_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).withColumn("price", F.floor(F.col("price").cast("double") / 30000))
    return money(state.observation_log(state.with_change(rows, ORDER)).groupBy("change_detected").agg(F.count("*").alias("n"), F.min("observed_at").alias("first_at")))


HISTORY = f"WITH {CHANGES}, page AS (SELECT *, row_number() OVER (ORDER BY observed_at DESC, batch_id DESC, row_index DESC, clinic_id, service_id, currency, price) AS rn FROM changes WHERE status <> 'unchanged' AND observed_at >= {NOW_TEXT} - 120)"


@query(HISTORY + f" SELECT batch_id, row_index, clinic_id, service_id, CAST(observed_at AS VARCHAR) AS observed_at, CASE WHEN (SELECT count(*) FROM page) > 100 THEN 1 ELSE 0 END AS has_more, CASE WHEN date_diff('day', observed_at, {NOW_TEXT}) > 90 THEN 1 ELSE 0 END AS is_historical FROM page WHERE rn BETWEEN 51 AND 100")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    changes = state.history(state.with_change(observations(spark, d), ORDER))
    page = S.history_page(changes, 2, 50, since=F.date_sub(now(), 120))
    return money(page.select("batch_id", F.col("row_index").cast("int").alias("row_index"), "clinic_id", "service_id", "observed_at", "has_more", rules.is_historical(F.col("observed_at").cast("timestamp"), now().cast("timestamp")).alias("is_historical")))


@query(HISTORY + " SELECT batch_id, row_index, page.clinic_id, page.service_id, p_name AS service_name, p_brand AS category, s_name AS clinic_name, n_name AS city, status FROM page JOIN part ON p_partkey = service_id JOIN supplier ON s_suppkey = clinic_id JOIN nation ON n_nationkey = s_nationkey WHERE rn <= 50")
def history_with_names(spark: SparkSession, d: str) -> DataFrame:
    changes = state.history(state.with_change(observations(spark, d), ORDER))
    page = S.with_names(S.history_page(changes, 1, 50, since=F.date_sub(now(), 120)), star(spark, d))
    return page.select("batch_id", F.col("row_index").cast("long").alias("row_index"), "clinic_id", "service_id", "service_name", "category", "clinic_name", "city", "status")


@query(f"WITH {CHANGES} SELECT count(*) FILTER (status <> 'unchanged') AS change_count, count(*) AS observation_count, CAST(min(observed_at) AS VARCHAR) AS first_at, CAST(max(observed_at) AS VARCHAR) AS last_at, CAST(min(price) AS DOUBLE) AS min_price, CAST(max(price) AS DOUBLE) AS max_price, {mean_sql('price')} AS average_price FROM changes WHERE clinic_id = 9")
def history_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where("clinic_id = 9")  # the clinic is part of the key, so the filter can come first
    return money(S.history_stats(state.with_change(rows, ORDER)))


@query("SELECT l_orderkey AS batch_id, count(*) FILTER (l_linestatus = 'O') AS good, count(*) FILTER (l_linestatus <> 'O') AS bad, CASE WHEN count(*) FILTER (l_linestatus <> 'O') = 0 THEN 'success' WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'partial_success' ELSE 'failed' END AS status FROM lineitem GROUP BY 1")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    """Line items that are open count as imported, the others as rejected."""
    o = observations(spark, d)
    log = state.batch_log(state.with_change(o.where("is_available"), ORDER), o.where("not is_available"))
    good = F.col("created_count") + F.col("updated_count") + F.col("unchanged_count")
    return log.select("batch_id", good.alias("good"), F.col("error_count").alias("bad"), "status")


@query("WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier), n AS (SELECT s_suppkey + 50 AS id, s_name || '!' AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance FROM supplier) SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE s.name END AS name, coalesce(CASE WHEN n.id IS NOT NULL THEN n.balance ELSE s.balance END, -1) AS balance, CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM s FULL JOIN n ON s.id = n.id")
def upsert_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, and all of them again under keys moved by 50."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    new = s.select((F.col("id") + 50).alias("id"), F.concat("name", F.lit("!")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("balance")).alias("balance"))
    return upsert.upsert(s, new, ["id"]).na.fill(-1.0, ["balance"])


@query("WITH s AS (SELECT c_custkey AS id, c_custkey % 40 AS ext, c_nationkey AS city, c_mktsegment AS name FROM customer WHERE c_custkey % 2 = 0), p AS (SELECT ext, min(id) AS id FROM s GROUP BY 1), f AS (SELECT city, name, min(id) AS id FROM s GROUP BY 1, 2) SELECT c_custkey AS row_id, coalesce(p.id, f.id, -1) AS id FROM customer c LEFT JOIN p ON p.ext = c.c_custkey % 80 LEFT JOIN f ON f.city = c.c_nationkey AND f.name = c.c_mktsegment")
def key_resolution(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stored = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("ext"), F.col("c_nationkey").alias("city"), F.col("c_mktsegment").alias("name"))
    incoming = c.select(F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 80).alias("ext"), F.col("c_nationkey").alias("city"), F.col("c_mktsegment").alias("name"))
    return match.resolve_keys(incoming, stored, ["ext"], ["city", "name"]).select("row_id", F.coalesce("id", F.lit(-1)).cast("long").alias("id"))


# -- freshness


@query(f"SELECT {FRESH} AS freshness, count(*) AS n FROM (SELECT greatest(date_diff('day', CAST(l_shipdate AS DATE), {NOW_TEXT}), 0) AS age_days FROM lineitem) GROUP BY 1")
def freshness_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.with_freshness(observations(spark, d), now()).groupBy("freshness").agg(F.count("*").alias("n"))


@query(f"WITH {CUR}, aged AS (SELECT *, greatest(date_diff('day', observed_at, {NOW_TEXT}), 0) AS age_days FROM cur), told AS (SELECT *, {FRESH} AS freshness FROM aged) SELECT clinic_id, service_id, currency, age_days, freshness, CASE freshness WHEN 'fresh' THEN 'Fresh/green' WHEN 'stale' THEN 'Stale/yellow' ELSE 'Expired/red' END AS badge, coalesce(CASE freshness WHEN 'stale' THEN 'Price data is 31-90 days old; verify current accuracy' WHEN 'expired' THEN 'Price data is over 90 days old; may not reflect current prices' END, '') AS warning FROM told")
def freshness_detail(spark: SparkSession, d: str) -> DataFrame:
    rows = S.with_freshness(state.latest(observations(spark, d), ORDER), now())
    b = rules.badge("freshness")
    return money(rows.select("clinic_id", "service_id", "currency", "age_days", "freshness", F.concat_ws("/", b["label"], b["color"]).alias("badge"), F.coalesce(rules.freshness_warning("freshness"), F.lit("")).alias("warning")))


# -- matching


CATALOG_SQL = "catalog AS (SELECT min(p_partkey) AS id, p_brand AS category, p_name AS name, 'alt ' || p_name AS alias FROM part GROUP BY p_brand, p_name)"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("aliases", F.array(F.concat(F.lit("Alt "), F.col("name"))))


def catalog_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts under names that are exact, an alias, or unknown in turn."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    name = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("alt  "), "p_name")).otherwise(F.concat("p_name", F.lit(" deluxe")))
    return p.select(F.col("p_partkey").alias("item_id"), name.alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("Brand#99").alias("category"))


MATCH = f"""WITH {CATALOG_SQL}, keys AS (SELECT id, category, lower(name) AS key, 0 AS kind FROM catalog UNION ALL SELECT id, category, lower(alias), 1 FROM catalog),
items AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_name) WHEN p_partkey % 3 = 1 THEN 'alt ' || lower(p_name) ELSE lower(p_name) || ' deluxe' END AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Brand#99' END AS own FROM part),
found AS (SELECT item_id, id, kind, row_number() OVER (PARTITION BY item_id ORDER BY (category = own) DESC, id, kind) AS rn FROM items JOIN keys USING (key)), best AS (SELECT * FROM found WHERE rn = 1)"""


@query(MATCH + " SELECT item_id, coalesce(id, -1) AS normalized_id, CASE WHEN kind = 0 THEN 'matched' WHEN kind = 1 THEN 'alias_matched' ELSE 'unmatched' END AS status, CAST(CASE WHEN kind = 0 THEN 1.0 WHEN kind = 1 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS confidence FROM items LEFT JOIN best USING (item_id)")
def catalog_match(spark: SparkSession, d: str) -> DataFrame:
    return money(match.match_catalog(catalog_items(spark, d), catalog(spark, d)).na.fill(-1, ["normalized_id"]))


@query(MATCH + " SELECT item_id, own AS category FROM items WHERE item_id NOT IN (SELECT item_id FROM best)")
def unmatched_anti(spark: SparkSession, d: str) -> DataFrame:
    items = catalog_items(spark, d)
    return match.unmatched(items, match.match_catalog(items, catalog(spark, d))).select("item_id", "category")


@query(f"WITH {CATALOG_SQL}, keys AS (SELECT id, lower(name) AS key FROM catalog UNION SELECT id, lower(alias) FROM catalog) SELECT p_partkey AS service_id, min(id) AS normalized_service_id FROM part JOIN keys ON key = lower(p_name) GROUP BY 1")
def relink_services(spark: SparkSession, d: str) -> DataFrame:
    services = table(spark, d, "part").select(F.col("p_partkey").alias("service_id"), F.col("p_name").alias("name"))
    return match.relink(services, catalog(spark, d))


def ratio_sql(a: str, b: str) -> str:
    """CTEs ``ratio`` (a, b, similarity) for all pairs of two sets of short names: the longest common run, then what is left of it and right of it, again and again."""
    return f"""pairs AS (SELECT x.n AS a, y.n AS b FROM ({a}) x, ({b}) y),
hit AS (SELECT a, b, i, j FROM pairs, unnest(range(1, length(a) + 1)) t(i), unnest(range(1, length(b) + 1)) u(j) WHERE substr(a, i, 1) = substr(b, j, 1)),
runs AS (SELECT a, b, i, j, max(i) OVER (PARTITION BY a, b, i - j, island) - i + 1 AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM hit)),
part_ AS (SELECT a, b, CAST(1 AS BIGINT) AS al, CAST(length(a) + 1 AS BIGINT) AS ah, CAST(1 AS BIGINT) AS bl, CAST(length(b) + 1 AS BIGINT) AS bh, CAST(0 AS BIGINT) AS m FROM pairs
  UNION ALL SELECT a, b, CASE s WHEN 0 THEN al ELSE best.k - best.i END, CASE s WHEN 0 THEN -best.i ELSE ah END, CASE s WHEN 0 THEN bl ELSE best.k - best.j END, CASE s WHEN 0 THEN -best.j ELSE bh END, CASE s WHEN 0 THEN best.k ELSE 0 END
  FROM (SELECT p.a, p.b, al, ah, bl, bh, max(struct_pack(k := least(k, ah - i, bh - j), i := -i, j := -j)) AS best FROM part_ p JOIN runs r ON p.a = r.a AND p.b = r.b AND i >= al AND i < ah AND j >= bl AND j < bh GROUP BY ALL), (VALUES (0), (1)) side(s)),
ratio AS (SELECT a, b, 2.0 * CAST(sum(m) AS DOUBLE) / (length(a) + length(b)) AS similarity FROM part_ GROUP BY a, b)"""


@query(f"""WITH RECURSIVE {CATALOG_SQL}, {ratio_sql("SELECT DISTINCT lower(p_name) || ' s' AS n FROM part", "SELECT DISTINCT lower(p_name) AS n FROM part")},
best AS (SELECT a, id, similarity, CAST(row_number() OVER (PARTITION BY a ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM ratio JOIN catalog ON b = lower(name) WHERE similarity >= 0.85)
SELECT p_partkey AS item_id, id, similarity, rank FROM part JOIN best ON a = lower(p_name) || ' s' WHERE rank <= 5""")
def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.lit(" s")).alias("name"))
    return match.fuzzy_candidates(items, catalog(spark, d), 0.85)


@query(MATCH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {ratio_sql("SELECT DISTINCT key AS n FROM items", "SELECT DISTINCT lower(name) AS n FROM catalog")},
exact AS (SELECT lower(name) AS key, min(id) AS id, arg_min(name, id) AS name FROM catalog GROUP BY 1),
near AS (SELECT a, id, name, similarity FROM ratio JOIN catalog ON b = lower(name) WHERE similarity >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, id) = 1)
SELECT item_id, CASE WHEN e.id IS NOT NULL THEN 'exact_matched' WHEN n.id IS NOT NULL THEN 'fuzzy_matched' ELSE 'unmatched' END AS match_type, coalesce(e.id, n.id, -1) AS normalized_id, coalesce(e.name, n.name, '') AS service_name,
  CASE WHEN e.id IS NOT NULL THEN 1.0 ELSE coalesce(n.similarity, 0.0) END AS confidence, '' AS qualifiers FROM items i LEFT JOIN exact e ON e.key = i.key LEFT JOIN near n ON n.a = i.key""")
def match_cascade(spark: SparkSession, d: str) -> DataFrame:
    told = match.match_service(catalog_items(spark, d), catalog(spark, d), 0.9)
    return told.select("item_id", "match_type", F.coalesce("normalized_id", F.lit(-1)).alias("normalized_id"), F.coalesce("service_name", F.lit("")).alias("service_name"), "confidence", F.array_join("quals", ",").alias("qualifiers"))


@query("SELECT l_partkey AS service_id, count(*) AS occurrence_count, CAST(min(CAST(l_shipdate AS DATE)) AS VARCHAR) AS first_seen_at, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last_seen_at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def unmatched_occurrence(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("service_id"), F.col("l_shipdate").cast("date").alias("seen_at"), F.col("l_linestatus").alias("raw_name"))
    return money(workflow.occurrences(seen).drop("raw_name").orderBy(F.desc("occurrence_count"), "service_id").limit(25))


QUEUE_STATUS = "CASE doc_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'needs_clarification' ELSE 'ignored' END"


def queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("record_id"), F.expr(QUEUE_STATUS).alias("status"))


@query(f"SELECT count(*) AS total, count(*) FILTER (s = 'open') AS open, count(*) FILTER (s = 'needs_clarification') AS needs_clarification, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'ignored') AS ignored FROM (SELECT {QUEUE_STATUS} AS s FROM labels)")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return workflow.queue_stats(queue(spark, d))


@query(f"WITH q AS (SELECT doc_id AS record_id, {QUEUE_STATUS} AS old FROM labels), a AS (SELECT *, CASE record_id % 7 WHEN 0 THEN 'approve_to_existing' WHEN 1 THEN 'approve_with_new_synonym' WHEN 2 THEN 'create_new_service' WHEN 3 THEN 'reject' WHEN 4 THEN 'needs_clarification' WHEN 5 THEN 'ignore' ELSE 'merge' END AS action FROM q), e AS (SELECT *, CASE WHEN old NOT IN ('open', 'needs_clarification') THEN 'Record is not reviewable' WHEN record_id % 7 IN (0, 1) AND record_id % 4 <> 0 THEN 'Target service not found' WHEN record_id % 7 = 1 AND record_id % 8 = 0 THEN 'Synonym is required' WHEN record_id % 7 = 6 THEN 'Unknown action' END AS err FROM a) SELECT record_id, action, CASE WHEN err IS NOT NULL THEN 'error' WHEN action = 'reject' THEN 'rejected' WHEN action = 'ignore' THEN 'ignored' WHEN action = 'needs_clarification' THEN 'needs_clarification' ELSE 'approved' END AS new_status, coalesce(err, '') AS error FROM e")
def review_transitions(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("approve_to_existing", "approve_with_new_synonym", "create_new_service", "reject", "needs_clarification", "ignore", "merge")
    r = F.col("record_id")
    actions = queue(spark, d).select("record_id", F.element_at(F.array(*map(F.lit, kinds)), (r % 7 + 1).cast("int")).alias("action"), (r % 4).alias("target_id"), F.when(r % 8 != 0, F.concat(F.lit("Name "), r.cast("string"))).alias("synonym"), F.lit("new").alias("new_name"), F.lit("lab").alias("new_category"), F.lit(None).cast("string").alias("note"))
    items = spark.createDataFrame([(0,)], "id long")
    return workflow.review(queue(spark, d), actions, items).select("record_id", "action", "new_status", F.coalesce("error", F.lit("")).alias("error"))


# -- text


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("normalized"))


@query("SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\\s+', ' ', 'g')) AS normalized FROM documents")
def normalize_whole_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("normalized"))


NAME_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[–—]', '-', 'g'), '[^\\p{L}\\p{M}\\p{N}_\\s\\-/()]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT item_id, {NAME_SQL} AS normalized FROM benchmark")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", X.normalize_name("text").alias("normalized"))


NAMES = [("мрт головы с контрастом срочно", 0), ("узи", 1), ("детский комплекс пцр", 2), ("ЭКГ right", 3), ("Нур-Султан", 4), ("Almaty", 5), ("OAK", 6), ("cbc", 7), ("CT", 8), ("12 500,50 тг", 9), ("1.2.3", 10), ("до 3 дней", 11), ("вес от 60 кг", 12), ("https://x.example/shymkent/a", 13), ("Ёж  ё", 14), ("", 15)]


def in_turn(values: list[str], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def in_turn_sql(values: list[str], k: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{k} % {len(values)} + 1]"


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names of all parts, each after one of NAMES in turn."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", in_turn([n for n, _ in NAMES], F.col("p_partkey")), "p_name").alias("name"))


NAMES_SQL = f"names AS (SELECT p_partkey AS id, {in_turn_sql([n for n, _ in NAMES], 'p_partkey')} || ' ' || p_name AS name FROM part)"
GROUP_SQL = "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{g}' END" for g, words in vocab.QUALIFIERS.items()) + ")"


@query(f"WITH {NAMES_SQL} SELECT CAST(id AS BIGINT) AS id, {GROUP_SQL} AS qualifiers FROM names")
def qualifiers(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", F.array_join(X.qualifiers("name"), ",").alias("qualifiers"))


ALIAS_SQL = "aliases AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in vocab.city_aliases().items()) + ") AS t(form, city))"


FORMS = [*vocab.city_aliases(), "Ёж  ё", "Almaty", "Нур-Султан", ""]


@query(f"WITH {ALIAS_SQL}, named AS (SELECT c_custkey AS id, {in_turn_sql(FORMS, 'c_custkey')} AS name FROM customer) SELECT id, coalesce(city, trim(regexp_replace(replace(lower(name), 'ё', 'е'), '\\s+', ' ', 'g'))) AS city FROM named LEFT JOIN aliases ON form = lower(name)")
def city_alias(spark: SparkSession, d: str) -> DataFrame:
    """All customers, in the cities of FORMS in turn."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.normalize_city(in_turn(FORMS, F.col("c_custkey"))).alias("city"))


@query(f"WITH {ALIAS_SQL}, named AS (SELECT trim(regexp_replace(replace(lower({in_turn_sql(FORMS, 'c_custkey')}), 'ё', 'е'), '\\s+', ' ', 'g')) AS name FROM customer) SELECT coalesce(city, name) AS city, string_agg(DISTINCT name, ',' ORDER BY name) AS aliases FROM named LEFT JOIN aliases ON form = name GROUP BY 1")
def city_alias_reverse(spark: SparkSession, d: str) -> DataFrame:
    """The forms under which customers name each city."""
    named = table(spark, d, "customer").select(in_turn(FORMS, F.col("c_custkey")).alias("name"))
    aliases = named.select(X.normalize_text("name").alias("form"), X.normalize_city("name").alias("city"))
    return S.city_aliases_reversed(aliases).select("city", F.array_join("aliases", ",").alias("aliases"))


#: What the queries "mri" and "CT" stand for, written out for the SQL.
TERMS_SQL = "(VALUES ('mri'), ('мрт'), ('magnetic resonance imaging'), ('магнитно-резонансная томография'), ('ct'), ('кт'), ('computed tomography')) AS t(term)"


@query(f"WITH {NAMES_SQL} SELECT term, count(*) AS hits FROM names, {TERMS_SQL} WHERE contains(lower(name), term) GROUP BY 1")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    terms = X.expand_query("mri") + X.expand_query("CT")
    hits = names(spark, d).agg(*[F.count_if(F.lower("name").contains(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    return hits.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(terms)]))).where("hits > 0")


@query("SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(strip_accents(lower(trim(p_name || ' ' || p_brand))), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("SELECT event_id, coalesce(TRY_CAST(nullif(replace(regexp_replace('KZT ' || CAST(event_id AS VARCHAR) || ',500.25 тг', '[^0-9.,]', '', 'g'), ',', ''), '') AS DOUBLE), -1) AS price FROM events")
def price_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("KZT "), F.col("event_id").cast("string"), F.lit(",500.25 тг"))
    return table(spark, d, "events").select("event_id", F.coalesce(X.parse_price(raw).cast("double"), F.lit(-1.0)).alias("price"))


@query("SELECT event_id, CASE WHEN event_id % 1000 BETWEEN 1 AND 365 THEN (event_id % 1000) * 1440 ELSE -1 END AS minutes FROM events")
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    days = X.parse_days(F.concat(F.lit("до "), (F.col("event_id") % 1000).cast("string"), F.lit(" дней")))
    return table(spark, d, "events").select("event_id", F.coalesce(X.days_to_minutes(days), F.lit(-1)).cast("long").alias("minutes"))


@query(f"WITH {NAMES_SQL} SELECT CAST(id AS BIGINT) AS id, regexp_extract(lower(name), 'вес\\s+(?:от\\s+)?([0-9]+)\\s*(?:кг)?', 0) AS weight, CASE WHEN contains(lower(name), 'контраст') THEN 1 ELSE 0 END AS contrast, CASE WHEN contains(lower(name), '/shymkent/') THEN 'Шымкент' ELSE 'Алматы' END AS city FROM names")
def name_flags(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).select("id", F.coalesce(X.weight_limit("name"), F.lit("")).alias("weight"), X.has_contrast("name").cast("int").alias("contrast"), X.city_from_path("name").alias("city"))


# -- validation


ROWS_SQL = "rows AS (SELECT l_orderkey AS batch_id, l_linenumber AS row_index, l_extendedprice, l_partkey % 11 AS k FROM lineitem)"


def import_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as import rows, some spoilt: k = 0 no name, 1 negative price, 2 no currency, 3 no date, 4 a bad URL."""
    k, no = F.col("l_partkey") % 11, F.lit(None)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_linenumber").alias("row_index"),
        F.when(k == 0, "  ").otherwise("svc").alias("name"),
        F.lit("lab").alias("category"),
        F.when(k == 1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("string").alias("price"),
        F.when(k == 2, "").otherwise(F.lower("l_returnflag")).alias("currency"),
        F.when(k == 3, "soon").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("updated_at"),
        F.when(k == 4, "ftp://a").otherwise("https://a.example/p").alias("source_url"),
        no.cast("long").alias("raw_source_row_id"),
        no.cast("int").alias("duration_minutes"),
        no.cast("boolean").alias("is_available"),
    )


@query(f"WITH {ROWS_SQL} SELECT batch_id, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM rows WHERE k > 4 GROUP BY 1")
def validate_rows(spark: SparkSession, d: str) -> DataFrame:
    good, _ = validate.split_rows(import_rows(spark, d))
    return money(good.groupBy("batch_id").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


@query(f"WITH {ROWS_SQL} SELECT batch_id, 'services[' || CAST(row_index AS VARCHAR) || '].' || CASE k WHEN 0 THEN 'name' WHEN 1 THEN 'price' WHEN 2 THEN 'currency' WHEN 3 THEN 'updated_at' ELSE 'source_url' END AS field_path, CASE k WHEN 1 THEN 'Input should be greater than or equal to 0' WHEN 3 THEN 'Input should be a valid date' WHEN 4 THEN 'Source URL must be a valid URL' ELSE 'Field is required' END AS message FROM rows WHERE k <= 4")
def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    _, bad = validate.split_rows(import_rows(spark, d))
    return bad.select("batch_id", "field_path", "message")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'rejected' WHEN p_partkey % 13 = 1 THEN 'rejected' WHEN p_partkey % 13 = 2 OR p_retailprice > 1500 THEN 'quarantined' ELSE 'accepted' END AS disposition FROM part")
def profile_triage(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey") % 13, table(spark, d, "part")
    cells = F.when(k == 0, F.array(F.lit("x"))).when(k == 1, F.array(F.lit("1"), F.lit(" "), F.lit("5"))).when(k == 2, F.array(F.lit("1"), F.col("p_name"), F.lit("n/a"))).otherwise(F.array(F.lit("1"), F.col("p_name"), F.col("p_retailprice").cast("string")))
    return p.select(F.col("p_partkey").alias("id"), validate.triage(cells, 1, 2, 0, 1500)["disposition"].alias("disposition"))


@query("SELECT page_id, CASE WHEN (starts_with(path, '/e') OR starts_with(path, '/d')) AND NOT starts_with(path, '/es') THEN 1 ELSE 0 END AS allowed FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    prefixes = lambda *p: F.array(*map(F.lit, p))
    return table(spark, d, "pages").select("page_id", validate.path_allowed(F.col("url"), prefixes("/e", "/d"), prefixes("/es")).cast("int").alias("allowed"))


def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same rows numbered within their order, with their clinics, each known to three sources, as ``import_batch`` takes them."""
    li = table(spark, d, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    li = li.withColumn("row", F.row_number().over(place))
    text = lambda c: F.col(c).cast("string")
    k, no = F.col("l_partkey") % 11, F.lit(None).cast("string")
    spot = lambda ext, name: F.struct(ext.alias("external_id"), name.alias("name"), F.concat(F.lit("city "), (F.col("l_suppkey") % 7).cast("string")).alias("city"), no.alias("address"))
    return li.select(
        F.lpad(text("l_orderkey"), 12, "0").alias("batch_id"),
        F.col("row").alias("row_index"),
        F.concat(F.lit("source "), "l_returnflag").alias("source"),
        spot(text("l_suppkey"), F.concat(F.lit("Clinic "), text("l_suppkey"))).alias("clinic"),
        spot(no, F.lit("Default branch")).alias("branch"),
        text("l_partkey").alias("external_id"),
        F.when(k == 0, "  ").otherwise(F.concat(F.lit("svc "), text("l_partkey"))).alias("name"),
        F.lit("lab").alias("category"),
        no.alias("description"),
        F.when(k == 1, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("string").alias("price"),
        F.when(k == 2, "").otherwise("kzt").alias("currency"),
        F.when(k == 3, "soon").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("updated_at"),
        F.when(k == 4, "ftp://a").otherwise("https://a.example/p").alias("source_url"),
        F.lit(None).cast("timestamp").alias("parsed_at"),
        F.lit(None).cast("long").alias("raw_source_row_id"),
        no.alias("raw_item"),
        F.lit(None).cast("int").alias("duration_minutes"),
        F.lit(None).cast("boolean").alias("is_available"),
    ).select(*ROW)


@query("""WITH rows AS (SELECT l_suppkey AS s, l_partkey AS p, l_orderkey AS batch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag) AS row_index, l_extendedprice, l_partkey % 11 AS k FROM lineitem), v AS (SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) AS price FROM rows WHERE k > 4),
o AS (SELECT *, lag(price) OVER w AS before, first_value(price) OVER (PARTITION BY s, p ORDER BY batch_id DESC, row_index DESC) AS last FROM v WINDOW w AS (PARTITION BY s, p ORDER BY batch_id, row_index)),
obs AS (SELECT 1 AS version, CASE WHEN before IS NULL THEN 'created' WHEN before = price THEN 'unchanged' ELSE 'updated' END AS status FROM o UNION ALL SELECT 2, CASE WHEN coalesce(before, last) = price THEN 'unchanged' ELSE 'updated' END FROM o)
SELECT 'observations' AS "table", CAST(version AS BIGINT) AS version, status, count(*) AS n FROM obs GROUP BY ALL UNION ALL SELECT 'history', version, status, count(*) FROM obs WHERE status <> 'unchanged' GROUP BY ALL
UNION ALL SELECT 'rejects', version, 'VALIDATION_ERROR', count(*) FROM rows, (VALUES (1), (2)) AS t(version) WHERE k <= 4 GROUP BY ALL UNION ALL SELECT 'raw_rows', version, CASE WHEN k > 4 THEN 'valid' ELSE 'invalid' END, count(*) FROM rows, (VALUES (1), (2)) AS t(version) GROUP BY ALL
UNION ALL SELECT 'batches', version, CASE WHEN good = n THEN 'success' WHEN good = 0 THEN 'failed' ELSE 'partial_success' END, count(*) FROM (SELECT batch_id, count(*) AS n, count(*) FILTER (k > 4) AS good FROM rows GROUP BY 1), (VALUES (1), (2)) AS t(version) GROUP BY ALL
UNION ALL SELECT 'clinics', 2, '', count(DISTINCT s) FROM v UNION ALL SELECT 'branches', 2, '', count(DISTINCT s) FROM v UNION ALL SELECT 'services', 2, '', count(DISTINCT p) FROM v UNION ALL SELECT 'categories', 2, '', 1
UNION ALL SELECT 'sources', 2, '', count(DISTINCT l_returnflag) FROM lineitem WHERE l_partkey % 11 > 4 UNION ALL SELECT 'current', 2, '', count(DISTINCT (s, p)) FROM v""")
def import_twice(spark: SparkSession, d: str) -> DataFrame:
    """All line items imported, the same run replayed, and imported again under another run: rows of every table by version and status."""
    lake, rows = Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}"), payload_rows(spark, d)
    landed = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"  # what is imported is landed once, as files of payloads are
    with shuffles_removed(spark):
        rows.write.option("compression", CODEC).parquet(landed)
    rows = spark.read.schema(rows.schema).parquet(landed)
    for run in ("one", "one", "two"):
        ingest.import_batch(rows, lake.folder, run_id=run)
    logs = {"observations": "status", "history": "change_type", "rejects": "code", "raw_rows": "validation_status", "batches": "status"}
    counts = [lake.log(t).groupBy("version", F.col(c).alias("status")).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "version", "status", "n") for t, c in logs.items()]
    for t in ("clinics", "branches", "services", "categories", "sources", "current"):
        counts.append(ingest.stored(lake, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), F.lit(lake.version()).cast("long").alias("version"), F.lit("").alias("status"), "n"))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


MODEL_ROWS = """WITH r AS (SELECT *, CAST(p_retailprice AS DECIMAL(12,2)) AS price, length(p_name) % 2 = 0 AS known, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) % 3 AS src, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
c AS (SELECT *, lag(price) OVER w AS before, row_number() OVER (PARTITION BY p_brand, p_name, p_type ORDER BY i DESC) AS back FROM r WINDOW w AS (PARTITION BY p_brand, p_name, p_type ORDER BY i)),
s AS (SELECT p_name, p_type, any_value(known) AS known, min(p_partkey) AS id, count(*) AS n FROM r GROUP BY 1, 2)"""


def part_payloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each brand as one clinic's payload of its parts: the rows, the roots (with one invalid root for each region) and a catalogue, in which names of odd length go by another name."""
    p, no = table(spark, d, "part"), F.lit(None).cast("string")
    source = F.concat(F.lit("source "), (F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") % 3).cast("string"))
    clinic = F.struct(F.col("p_brand").alias("external_id"), F.concat(F.lit("Clinic "), "p_brand").alias("name"), F.lit("city").alias("city"), no.alias("address"))
    branch = F.struct(no.alias("external_id"), F.lit("Default branch").alias("name"), F.lit("city").alias("city"), no.alias("address"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = p.select(
        F.col("p_brand").alias("batch_id"), place.alias("row_index"), source.alias("source"), clinic.alias("clinic"), branch.alias("branch"), no.alias("external_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), no.alias("description"),
        F.col("p_retailprice").cast("string").alias("price"), F.lit("kzt").alias("currency"), F.lit("2001-10-20").alias("updated_at"), F.lit("https://a.example/p").alias("source_url"), F.lit(None).cast("timestamp").alias("parsed_at"), F.lit(None).cast("long").alias("raw_source_row_id"),
        no.alias("raw_item"), F.lit(None).cast("int").alias("duration_minutes"), F.lit(None).cast("boolean").alias("is_available"),
    ).select(*ROW)
    told = [no.alias("robots_policy_notes"), F.lit(5).alias("crawl_delay_seconds"), F.struct(F.lit("2001-10-20 00:00:00").cast("timestamp").alias("captured_at")).alias("raw_snapshot")]
    good = p.groupBy("p_brand").agg(F.min(source).alias("source")).select(F.col("p_brand").alias("source_batch_id"), "source", F.lit("site").alias("source_type"), F.lit("https://a.example").alias("source_url"), F.col("p_brand").alias("path"), *told, F.array().cast("array<string>").alias("root_errors"))
    bad = table(spark, d, "region").select(F.concat(F.lit("bad "), "r_name").alias("source_batch_id"), F.col("r_name").alias("source"), no.alias("source_type"), no.alias("source_url"), F.col("r_name").alias("path"), *told, F.array(F.lit("clinic"), F.lit("services")).alias("root_errors"))
    named = F.when(F.length("p_name") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" plus")))
    listed = p.groupBy(F.col("p_type").alias("category"), named.alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("aliases", F.array().cast("array<string>"))
    return rows, good.unionByName(bad), listed


@query(MODEL_ROWS + """ SELECT 'price' AS kind, 'Clinic ' || p_brand AS name, p_name || '/' || p_type AS detail, CAST(price AS DOUBLE) AS n FROM c WHERE back = 1
UNION ALL SELECT 'queue', p_name, p_type, n FROM s WHERE NOT known UNION ALL SELECT 'service', p_name || '/' || p_type, CASE WHEN known THEN 'matched' ELSE 'unmatched' END, CASE WHEN known THEN id ELSE -1 END FROM s
UNION ALL SELECT 'source', 'source ' || src, 'site', 5 FROM r GROUP BY src UNION ALL SELECT 'snapshot', 'source ' || min(src), p_brand, 1 FROM r GROUP BY p_brand UNION ALL SELECT 'quarantine', r_name, 'bad ' || r_name, 2 FROM region
UNION ALL SELECT 'batch', p_brand, 'success', count(*) FILTER (before IS NULL) FROM c GROUP BY p_brand UNION ALL SELECT 'batch', 'bad ' || r_name, 'failed', 0 FROM region
UNION ALL SELECT 'history', p_brand, CASE WHEN before IS NULL THEN 'created' ELSE 'updated' END, count(*) FROM c WHERE before IS NULL OR before <> price GROUP BY ALL""")
def import_model(spark: SparkSession, d: str) -> DataFrame:
    """What an import makes of several categories, sources and clinics with a catalogue and payload roots: prices by name, matches, queue, sources, snapshots, quarantine, batches, history."""
    rows, payloads, listed = part_payloads(spark, d)
    lake = Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    ingest.import_batch(rows, lake, listed, "one", payloads)
    c, star_ = F.col, ingest.star_of(lake)
    services = ingest.stored(lake, "services").join(ingest.stored(lake, "categories").select("category_id", c("name").alias("category")), "category_id")
    told = {
        "price": (star_.joined(), "clinic_name", F.concat("service_name", F.lit("/"), "category"), "price"),
        "queue": (ingest.stored(lake, "queue"), "raw_name", c("raw_category"), "occurrence_count"),
        "service": (services.withColumns({"name": F.concat("name", F.lit("/"), "category"), "id": F.coalesce("normalized_id", F.lit(-1))}), "name", c("match_status"), "id"),
        "source": (ingest.stored(lake, "sources"), "source", c("type"), "crawl_delay_seconds"),
        "snapshot": (lake.log("snapshots"), "source", c("batch_id"), "version"),
        "quarantine": (lake.log("quarantine").withColumn("n", F.size("root_errors")), "source", c("batch_id"), "n"),
        "batch": (lake.log("batches"), "batch_id", c("status"), "created_count"),
        "history": (lake.log("history").groupBy("batch_id", "change_type").agg(F.count("*").alias("n")), "batch_id", c("change_type"), "n"),
    }
    parts = [df.select(F.lit(kind).alias("kind"), c(name).alias("name"), detail.alias("detail"), c(n).cast("double").alias("n")) for kind, (df, name, detail, n) in told.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(MODEL_ROWS + """, f AS (SELECT count(*) FILTER (back = 1) AS current, count(*) AS seen, count(*) FILTER (before IS NULL OR before <> price) AS changed, count(DISTINCT src) AS sources, count(DISTINCT p_brand) AS brands FROM c), k AS (SELECT count(*) AS services, count(*) FILTER (NOT known) AS missed FROM s),
checks AS (SELECT unnest([('source_count', sources, 3, NULL), ('service_price_count', current, 15, NULL), ('normalized_catalog_count', services, 50, NULL), ('parser_run_count', 1, 3, NULL), ('raw_snapshot_count', brands, 3, NULL), ('raw_row_count', seen, 15, NULL), ('price_history_count', changed, 15, NULL), ('price_observation_count', seen, 15, NULL), ('deduplication', services, 15, NULL),
  ('missing_source_url', 0, NULL, 0), ('missing_parsed_at', current, NULL, 0), ('raw_row_integrity', seen, seen, seen), ('unmatched_count', missed, NULL, NULL), ('freshness_distribution', current, NULL, NULL)]) AS t FROM f, k)
SELECT t[1] AS "check", CASE WHEN coalesce(t[2] >= t[3], true) AND coalesce(t[2] <= t[4], true) THEN 1 ELSE 0 END AS passed, CAST(t[2] AS BIGINT) AS actual, concat_ws(' and ', '>= ' || t[3], '<= ' || t[4]) AS expected FROM checks""")
def dq_of_import(spark: SparkSession, d: str) -> DataFrame:
    """All 14 checks of an imported data set, from what the import has counted while it wrote."""
    rows, payloads, listed = part_payloads(spark, d)
    lake = Lake(spark, f"{shared_dir(spark)}/lake-{uuid.uuid4().hex}")
    ingest.import_batch(rows, lake, listed, "one", payloads)
    return money(quality.report(spark, lake, listed.count(), date.fromisoformat(NOW)))


# -- workflows


@query()
def alerts_eval(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    alerts = c.select(F.col("c_custkey").alias("alert_id"), F.element_at(F.array(F.lit("below"), F.lit("above"), F.lit("changed")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("kind"), (F.col("c_acctbal") * 10).cast("decimal(14,2)").alias("threshold"), (F.col("c_custkey") % 500).alias("normalized_service_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 100).alias("clinic_id"), F.lit(None).cast("long").alias("branch_id"), F.lit(True).alias("is_active"))
    prices = state.latest(observations(spark, d), ORDER).select(F.expr("(service_id * 100000 + clinic_id) * 4 + instr('ANR', currency)").alias("price_id"), F.col("service_id").alias("normalized_service_id"), "clinic_id", "branch_id", "price", "currency")
    return money(workflow.evaluate_alerts(alerts, prices).select("alert_id", "kind", F.coalesce("price", F.lit(-1)).cast("double").alias("price"), "fires"))


ORACLES["alerts_eval"] = f"""WITH {CUR}, prices AS (SELECT (service_id * 100000 + clinic_id) * 4 + instr('ANR', currency) AS price_id, * FROM cur),
alerts AS (SELECT c_custkey AS alert_id, CASE c_custkey % 3 WHEN 0 THEN 'below' WHEN 1 THEN 'above' ELSE 'changed' END AS kind, CAST(c_acctbal * 10 AS DECIMAL(14,2)) AS threshold, c_custkey % 500 AS sid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 END AS cid FROM customer),
found AS (SELECT alert_id, kind, threshold, arg_min(price, price_id) AS price FROM alerts LEFT JOIN prices ON service_id = sid AND (cid IS NULL OR clinic_id = cid) GROUP BY 1, 2, 3)
SELECT alert_id, kind, coalesce(CAST(price AS DOUBLE), -1) AS price, CASE WHEN price IS NULL THEN 0 WHEN kind = 'below' AND price < threshold THEN 1 WHEN kind = 'above' AND price > threshold THEN 1 WHEN kind = 'changed' THEN 1 ELSE 0 END AS fires FROM found"""


@query("""WITH last AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1), s AS (SELECT u AS source, CASE WHEN u % 4 = 0 THEN 'manual' ELSE 'live' END AS mode, CASE WHEN u % 3 = 0 THEN 24 ELSE 48 END AS hours FROM (SELECT DISTINCT user_id AS u FROM events))
SELECT CAST(source AS VARCHAR) AS source_id, CASE WHEN mode = 'live' AND (t IS NULL OR TIMESTAMP '2024-01-31 00:00:00' >= t + to_hours(hours)) THEN 1 ELSE 0 END AS should_run,
CASE WHEN mode <> 'live' THEN 'Source mode is manual, not live' WHEN t IS NULL THEN 'No previous successful run' WHEN TIMESTAMP '2024-01-31 00:00:00' >= t + to_hours(hours) THEN 'Scheduled interval elapsed' ELSE 'Not due yet' END AS reason FROM s LEFT JOIN last ON user_id = source""")
def schedule_eval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sources = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("source_id"), F.when(F.col("user_id") % 4 == 0, "manual").otherwise("live").alias("mode"), F.when(F.col("user_id") % 3 == 0, "P0").otherwise("P1").alias("priority"), F.lit(True).alias("enabled"))
    runs = e.where("event_type = 'purchase'").groupBy(F.col("user_id").cast("string").alias("source_id")).agg(F.max("ts").cast("timestamp").alias("finished_at")).withColumn("status", F.lit("success"))
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    told = workflow.evaluate_schedule(sources, runs, at, most_jitter=0)
    return told.select("source_id", F.col("should_run").cast("int").alias("should_run"), "reason")


@query("SELECT c_custkey AS clinic_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE '' END AS filled, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'name' ELSE '' END AS conflicts FROM customer")
def enrich_merge(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    clinics = c.select(k.alias("clinic_id"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("name"))
    offered = c.select(k.alias("clinic_id"), F.when((k % 3 == 0) | (k % 2 == 0), "new").otherwise(F.col("c_mktsegment")).alias("name"))
    return workflow.enrich(clinics, offered, ["name"]).select("clinic_id", "name", F.array_join("filled", ",").alias("filled"), F.array_join("conflicts", ",").alias("conflicts"))


@query("""WITH facts AS (SELECT 'source_count' AS "check", count(DISTINCT l_returnflag) AS actual, 3 AS least FROM lineitem UNION ALL SELECT 'service_price_count', count(*), 15 FROM lineitem UNION ALL SELECT 'normalized_catalog_count', count(DISTINCT p_name), 50 FROM part UNION ALL SELECT 'parser_run_count', count(*), 3 FROM orders)
SELECT "check", CASE WHEN actual >= least THEN 1 ELSE 0 END AS passed, actual, '>= ' || CAST(least AS VARCHAR) AS expected FROM facts UNION ALL SELECT 'missing_source_url', CASE WHEN n = 0 THEN 1 ELSE 0 END, n, '<= 0' FROM (SELECT count(*) FILTER (url IS NULL OR url = '') AS n FROM pages)""")
def dq_checks(spark: SparkSession, d: str) -> DataFrame:
    fact = lambda df, name, actual, least, most=None: df.agg(actual.cast("long").alias("actual")).select(F.lit(name).alias("check"), "actual", F.lit(least).cast("long").alias("least"), F.lit(most).cast("long").alias("most"))
    li = table(spark, d, "lineitem")
    facts = [
        fact(li, "source_count", F.count_distinct("l_returnflag"), 3),
        fact(li, "service_price_count", F.count("*"), 15),
        fact(table(spark, d, "part"), "normalized_catalog_count", F.count_distinct("p_name"), 50),
        fact(table(spark, d, "orders"), "parser_run_count", F.count("*"), 3),
        fact(table(spark, d, "pages"), "missing_source_url", F.count_if(F.coalesce("url", F.lit("")) == ""), None, 0),
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return money(workflow.dq_report(out))


@query("WITH a AS (SELECT p_brand AS slug, list_sort(list_distinct(list(p_type))) AS x FROM part GROUP BY 1), b AS (SELECT 'Brand#' || CAST(p_size AS VARCHAR) AS slug, list_sort(list_distinct(list(p_name))) AS x FROM part GROUP BY 1) SELECT coalesce(a.slug, b.slug) AS slug, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.x, []), coalesce(b.x, [])))), ',') AS aliases FROM a FULL JOIN b ON a.slug = b.slug")
def alias_union(spark: SparkSession, d: str) -> DataFrame:
    """Types of all parts by brand, and names of all parts by a brand made of their size."""
    p = table(spark, d, "part")
    side = lambda slug, alias: p.groupBy(slug.alias("slug")).agg(F.collect_set(alias).alias("aliases")).withColumn("name", F.col("slug")).withColumn("category", F.lit("c"))
    stored, seed = side(F.col("p_brand"), "p_type"), side(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")), "p_name")
    return upsert.seed_catalog(stored, seed).select("slug", F.array_join("aliases", ",").alias("aliases"))


@query("WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer), b AS (SELECT CAST(s_nationkey AS BIGINT) AS k FROM supplier UNION ALL SELECT CAST(s_suppkey AS BIGINT) FROM supplier) SELECT k, 'expected' AS side FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) UNION ALL SELECT k, 'actual' FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Nations of all customers, against nations and keys of all suppliers, each as often as it occurs."""
    s = table(spark, d, "supplier")
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    return upsert.set_difference(a, s.select(F.col("s_nationkey").cast("long").alias("k")).unionByName(s.select(F.col("s_suppkey").cast("long").alias("k"))))


@query("SELECT source, doc_id, CASE WHEN rn > 10 THEN 1 ELSE 0 END AS over_cap FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)")
def page_cap(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("position"))
    return validate.over_page_cap(pages, 10).select("source", "doc_id", F.col("over_cap").cast("int").alias("over_cap"))


@query("SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM conversations")
def section_ffill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.coalesce(state.carry_forward(F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn"]), F.lit(-1)).cast("long").alias("section"))


@query("SELECT event_type, coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("total"))


SUGGEST = """WITH c AS (SELECT p_name AS text, min(p_brand) AS category FROM part GROUP BY 1), q AS (SELECT p_name || ' kit' AS text, min(p_type) AS category, count(*) AS n FROM part GROUP BY 1),
hits AS (SELECT text, 1 AS tier, 1.0 AS confidence, category, 0 AS weight FROM c WHERE contains(lower(text), 'ring') UNION ALL SELECT text, 3, 0.5, category, n FROM q WHERE contains(lower(text), 'ring'))
SELECT text, CAST(tier AS BIGINT) AS tier, CAST(confidence AS DOUBLE) AS confidence, category, CAST(weight AS BIGINT) AS weight FROM hits ORDER BY tier, weight DESC, text LIMIT 20"""


@query(SUGGEST)
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    canonical = p.groupBy(F.col("p_name").alias("text")).agg(F.min("p_brand").alias("category"))
    synonyms = spark.createDataFrame([(k,) for k in X.synonym_index()], "text string")
    q = p.groupBy(F.concat("p_name", F.lit(" kit")).alias("text")).agg(F.min("p_type").alias("category"), F.count("*").alias("occurrence_count")).withColumn("status", F.lit("open"))
    return money(S.autocomplete(canonical, synonyms, q, "Ring", 20))


# -- events, documents, hashes


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(f"SELECT {TS.format('time_bucket(INTERVAL 6 HOURS, ts)')} AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def tumbling_batch(spark: SparkSession, d: str) -> DataFrame:
    return money(streams.tumbling(events(spark, d), "6 hours").select(stamp("window.start").alias("start"), "event_type", "n", "total"))


@query(f"SELECT {TS.format('s')} AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS s FROM events) GROUP BY 1")
def sliding_batch(spark: SparkSession, d: str) -> DataFrame:
    return streams.sliding(events(spark, d), "12 hours", "6 hours").select(stamp("window.start").alias("start"), "n")


@query(f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, {TS.format('min(ts)')} AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_batch(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(events(spark, d), "2 hours").select("user_id", stamp("session_window.start").alias("start"), "n")


@query()
def html_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return documents.extract(pages).select("doc_id", F.col("truncated").cast("int").alias("truncated"), F.inline("blocks"))  # a reader sees where limits cut


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT event_id, sha256('{\"t\":\"' || event_type || '\",\"u\":' || CAST(user_id AS VARCHAR) || '}') AS hash FROM events")
def raw_record_hash(spark: SparkSession, d: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")))
    return table(spark, d, "events").select("event_id", X.record_hash(record).alias("hash"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'exact needs price' ELSE '' END WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'from needs price or price_min' ELSE '' END WHEN 2 THEN 'price_max is below price_min' ELSE 'base_fee_total needs base_price and total_price' END AS error FROM orders")
def price_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), F.element_at(F.array(*map(F.lit, ("exact", "from", "range", "base_fee_total"))), (k % 4 + 1).cast("int")).alias("q"), F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 4 == 2, 5.0).alias("price_min"), F.when(k % 4 == 2, 4.0).alias("price_max"), F.lit(1.0).alias("base_price"), F.lit(None).cast("double").alias("total_price"))
    return rows.select("id", F.coalesce(rules.price_qualifier_error("q"), F.lit("")).alias("error"))
