"""More registered queries over the driver's tables: rules, workflow and stores that ``queries`` leaves out, with their SQL.

Importing this module registers them; see ``queries`` for the correspondence of tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules
from .functions import text as X
from .operators import state, textindex, upsert, validate, workflow
from .plans import star as S
from .queries import PAGE, PAGE_COLUMNS, QUEUE_STATUS, SEARCH, STAR, money, query, star, table
from .session import shared_dir
from .sources import documents, profiles
from .sources.payloads import read_payloads, service_rows


def turn(number: str | Column, *values: object) -> Column:
    """The value whose place is the number modulo how many there are."""
    number = F.col(number) if isinstance(number, str) else number
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def turn_sql(number: str, *values: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST({number} % {len(values)} + 1 AS BIGINT)]"


# -- names and headings


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS number, p_name AS name, 1 AS heading, 0 AS line FROM part")
def section_headings(spark: SparkSession, d: str) -> DataFrame:
    """Part names as numbered headings of a price list, and as lines of it."""
    heading = F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name", F.lit(" - "))
    p = table(spark, d, "part").withColumn("heading", heading)
    section = X.is_section(F.array("heading", F.lit(""), F.lit(" ")))
    line = X.is_section(F.array("p_name", "p_type"))
    return p.select(F.col("p_partkey").alias("id"), X.section_number("heading").alias("number"), X.section_name("heading").alias("name"), section.cast("int").alias("heading"), line.cast("int").alias("line"))


@query("""SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_type END, p_brand) AS display, CASE WHEN p_size % 2 = 1 THEN p_name ELSE p_type END AS shown,
p_brand || '_row_' || CASE WHEN p_partkey < 100 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS row_id, 'https://maps.example.org/?q=' || replace(p_name, ' ', '+') AS link, lower(p_type) || '.example.org' AS host, p_name || '; ' || p_type AS hours FROM part""")
def shown_names(spark: SparkSession, d: str) -> DataFrame:
    size, blank = F.col("p_size"), F.lit("")
    display = X.display_name(F.when(size % 3 == 0, F.col("p_name")).otherwise(blank), F.when(size % 2 == 0, F.col("p_type")), blank, "p_brand")
    shown = X.shown_name(F.when(size % 2 == 1, "unmatched").otherwise("matched"), "p_name", "p_type")
    host = X.host_of(F.concat(F.lit("https://"), F.upper("p_type"), F.lit(".Example.org.:8080/a?b")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), display.alias("display"), shown.alias("shown"), X.row_id("p_brand", "p_partkey").alias("row_id"), X.map_link("p_name").alias("link"), host.alias("host"), X.opening_hours(F.array("p_name", "p_type")).alias("hours"))


# -- requests, locks and runs

MODES, SOURCE_MODES = ("fixture", "manual", "live", "other"), ("live", "scaffold", "permission_required", "api_required", "manual")


@query(f"""WITH r AS (SELECT o_orderkey AS id, {turn_sql("o_orderkey", *MODES)} AS mode, {turn_sql("o_custkey", *SOURCE_MODES)} AS source_mode, CASE WHEN o_custkey % 3 = 0 THEN 'Almaty' END AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'Astana' ELSE 'Almaty' END AS city, o_custkey % 20 AS pages FROM orders)
SELECT id, coalesce(CASE WHEN mode = 'other' THEN 'UNKNOWN_MODE' WHEN mode = 'live' AND source_mode = 'scaffold' THEN 'SCAFFOLD_ONLY' WHEN mode = 'live' AND source_mode = 'permission_required' THEN 'PERMISSION_REQUIRED' WHEN mode = 'live' AND source_mode = 'api_required' THEN 'API_REQUIRED'
WHEN scope IS NOT NULL AND scope <> city THEN 'CITY_OUT_OF_SCOPE' WHEN pages > 10 THEN 'PAGE_LIMIT_EXCEEDED' END, '') AS error FROM r""")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    asked = table(spark, d, "orders").select(c("o_orderkey").alias("id"), turn("o_orderkey", *MODES).alias("mode"), turn("o_custkey", *SOURCE_MODES).alias("source_mode"), F.when(c("o_custkey") % 3 == 0, "Almaty").alias("city_scope"), F.array(F.when(c("o_orderkey") % 2 == 0, "Astana").otherwise("Almaty")).alias("cities"), (c("o_custkey") % 20).alias("pages"), F.lit(10).alias("max_pages"))
    return asked.select("id", F.coalesce(validate.run_request_error(), F.lit("")).alias("error"))


@query("""WITH p AS (SELECT page_id, page_id % 3 AS k, lower(coalesce(html, '')) || CASE WHEN page_id % 5 = 0 THEN ' <b>recaptcha</b>' ELSE '' END AS body FROM pages)
SELECT page_id, CASE WHEN k = 2 THEN 'UNEXPECTED_CONTENT_TYPE' WHEN contains(body, 'captcha') OR contains(body, 'verify you are human') OR contains(body, 'cf-challenge') THEN 'CAPTCHA_DETECTED' ELSE '' END AS error FROM p""")
def content_errors(spark: SparkSession, d: str) -> DataFrame:
    """Pages under three content types, every fifth with a riddle for its readers at the front."""
    riddle = F.when(F.col("page_id") % 5 == 0, "<b>reCAPTCHA</b>").otherwise("")
    body = F.concat(riddle, F.coalesce("html", F.lit(""))).cast("binary")
    error = validate.content_error(turn("page_id", "text/html; charset=utf-8", " TEXT/HTML", "application/pdf"), body, ["text/html"])
    return table(spark, d, "pages").select("page_id", F.coalesce(error, F.lit("")).alias("error"))


@query("SELECT o_orderkey AS id, CASE WHEN epoch(TIMESTAMP '1998-08-01 00:10:00') - epoch(o_orderdate) >= 600 THEN 1 ELSE 0 END AS stale, pow(2.0, o_orderkey % 6) * 0.5 + 0.25 AS delay FROM orders")
def locks_and_retries(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("1998-08-01 00:10:00").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rules.lock_is_stale(F.col("o_orderdate").cast("timestamp"), now).cast("int").alias("stale"), rules.retry_delay(F.col("o_orderkey") % 6 + 1, 0.25).alias("delay"))


@query("""WITH e AS (SELECT user_id AS run_id, event_type AS stage, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n, string_agg(stage || ':' || n, ',' ORDER BY stage) AS stages FROM e GROUP BY 1)
SELECT c_custkey AS run_id, coalesce(n, 0) AS error_count, coalesce(stages, '') AS stages FROM customer LEFT JOIN s ON run_id = c_custkey""")
def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as runs, events as their errors by stage."""
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    log = workflow.run_log(runs, table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage")))
    listed = F.array_join(F.transform(F.map_entries("errors_by_stage"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return log.select("run_id", "error_count", F.coalesce(listed, F.lit("")).alias("stages"))


# -- queue, branches, alerts


@query(f"""WITH q AS (SELECT doc_id AS record_id, {QUEUE_STATUS} AS status, doc_id % 5000 AS service_id, DATE '2024-01-01' + CAST(doc_id % 50 AS INTEGER) AS seen FROM labels)
SELECT record_id, CAST(seen AS VARCHAR) AS last_seen_at, coalesce(p_name, '') AS service_name FROM q LEFT JOIN part ON p_partkey = service_id WHERE status = 'open' ORDER BY seen DESC, record_id LIMIT 20 OFFSET 20""")
def queue_pages(spark: SparkSession, d: str) -> DataFrame:
    """The second page of open records."""
    q = table(spark, d, "labels").select(F.col("doc_id").alias("record_id"), F.expr(QUEUE_STATUS).alias("status"), (F.col("doc_id") % 5000).alias("service_id"), F.expr("date_add(DATE '2024-01-01', CAST(doc_id % 50 AS INT))").alias("last_seen_at"))
    services = table(spark, d, "part").select(F.col("p_partkey").alias("service_id"), F.col("p_name").alias("service_name"))
    return money(workflow.queue_page(q, services, "open", None, 20, 20).select("record_id", "last_seen_at", F.coalesce("service_name", F.lit("")).alias("service_name")))


@query("SELECT n_name AS city, count(*) AS branch_count FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1")
def city_branch_counts(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return workflow.city_counts(places.select(F.col("n_name").alias("city"), (F.col("s_acctbal") > 0).alias("branch_active")))


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_custkey % 5 = 2) AS triggered_today FROM customer")
def alert_totals(spark: SparkSession, d: str) -> DataFrame:
    alerts = table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("is_active"), F.expr("date_add(DATE '2024-01-01', CAST(c_custkey % 5 AS INT))").cast("timestamp").alias("last_triggered_at"))
    return workflow.alert_counts(alerts, F.lit("2024-01-03").cast("date"))


@query("""WITH last AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1), s AS (SELECT DISTINCT user_id AS u FROM events),
e AS (SELECT u, u % 4 <> 0 AS able, t + to_hours(CASE WHEN u % 3 = 0 THEN 24 ELSE 48 END) AS due, t FROM s LEFT JOIN last ON user_id = u)
SELECT count(*) AS sources, count(*) FILTER (able AND (t IS NULL OR TIMESTAMP '2024-01-31 00:00:00' >= due)) AS due, strftime(min(CASE WHEN able THEN coalesce(due, TIMESTAMP '2024-01-31 00:00:00') END), '%Y-%m-%d %H:%M:%S') AS next_run_at, strftime((SELECT max(ts) FROM events WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS last_finished_at FROM e""")
def scheduler_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sources = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("source_id"), F.when(F.col("user_id") % 4 == 0, "manual").otherwise("live").alias("mode"), F.when(F.col("user_id") % 3 == 0, "P0").otherwise("P1").alias("priority"), F.lit(True).alias("enabled"))
    runs = e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("source_id"), F.col("ts").cast("timestamp").alias("finished_at"), F.lit("success").alias("status"))
    told = workflow.scheduler_status(workflow.evaluate_schedule(sources, runs, F.lit("2024-01-31 00:00:00").cast("timestamp"), most_jitter=0), runs)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return told.select("sources", "due", text("next_run_at"), text("last_finished_at"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_kept(spark: SparkSession, d: str) -> DataFrame:
    return state.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


# -- searches


@query(f"""WITH {STAR} SELECT 'service' AS by_, service_id, clinic_id, currency, '{{"service_id":' || service_id || ',"service_name":"' || service_name || '","category":"' || category || '"}}' AS service FROM star WHERE is_available AND service_id = 7
UNION ALL SELECT 'canonical', service_id, clinic_id, currency, '{{"service_id":' || service_id || ',"service_name":"' || service_name || '","category":"' || category || '"}}' FROM star WHERE is_available AND canonical_name = 'SMALL' AND star.price > 40000""")
def search_by_service(spark: SparkSession, d: str) -> DataFrame:
    """Prices of one service, and of all that one canonical name stands for above a price, as nested records."""
    s = star(spark, d)
    own = lambda by, rows: S.nested(rows).select(F.lit(by).alias("by_"), "service.service_id", "clinic.clinic_id", "price.currency", F.to_json("service").alias("service"))
    return own("service", S.filtered(s, service_id=7)).unionByName(own("canonical", S.filtered(s, canonical="SMALL", low=40000.01)))


@query(f"WITH {STAR} SELECT {PAGE} FROM star WHERE {SEARCH} ORDER BY star.price DESC, service_name, clinic_id, service_id, currency LIMIT 50")
def search_by_postings(spark: SparkSession, d: str) -> DataFrame:
    """A search whose candidates come from postings of the names."""
    s = star(spark, d)
    services = textindex.postings(s.services, "service_id", F.col("service_name"), F.col("canonical_name"), F.col("category"), X.normalize_name("service_name"))
    indexed = S.Star(s.prices, s.services, s.clinics, s.branches, services, textindex.postings(s.clinics, "clinic_id", F.col("clinic_name")))
    return money(S.search(indexed, "ing", "price_desc", 50, low=20000, high=60000).select(*PAGE_COLUMNS))


# -- stores and payloads


@query("SELECT page_id % 3 AS source, count(DISTINCT html) AS stored FROM pages WHERE html IS NOT NULL GROUP BY 1")
def stored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages stored twice by content: one row for each content of a source."""
    pages = table(spark, d, "pages").where("html is not null").select((F.col("page_id") % 3).alias("source"), F.col("html").cast("binary").alias("content"))
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    for _ in range(2):
        upsert.store_documents(pages, folder)
    return spark.read.parquet(folder).groupBy(F.col("source").cast("long").alias("source")).agg(F.count("*").alias("stored"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1998-01-01 00:00:00'")
def retained_snapshots(spark: SparkSession, d: str) -> DataFrame:
    taken = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("captured_at"))
    return upsert.retained(upsert.raw_snapshots(taken), F.lit("1998-01-01 00:00:00").cast("timestamp")).select("id")


PAYLOAD_PARTS = 5_000


@query(f"""SELECT p_brand || '-' || (p_partkey // {PAYLOAD_PARTS}) AS batch_id, CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // {PAYLOAD_PARTS} ORDER BY p_partkey) - 1 AS INTEGER) AS row_index, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS name, p_type AS category, CAST(p_retailprice AS VARCHAR) AS price, 'Clinic ' || p_brand AS clinic, 'Default branch' AS branch FROM part""")
def payload_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as payload files, one for each brand and stretch of keys, and read back as rows."""
    folder, no = f"{shared_dir(spark)}/payloads-{uuid.uuid4().hex}", F.lit("2024-01-01")
    p = table(spark, d, "part").withColumn("stretch", F.floor(F.col("p_partkey") / PAYLOAD_PARTS))
    one = F.struct("p_partkey", F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_retailprice").cast("string").alias("price"), F.lit("KZT").alias("currency"), no.alias("updated_at"))
    packed = p.groupBy("p_brand", "stretch").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s.dropFields("p_partkey")).alias("services"))  # PAYLOAD_PARTS at most
    clinic = F.struct(F.col("p_brand").alias("external_id"), F.concat(F.lit("Clinic "), "p_brand").alias("name"), F.lit("Astana").alias("city"))
    made = packed.select(F.to_json(F.struct(F.lit("parts").alias("source"), F.lit("https://a.example/p").alias("source_url"), F.concat_ws("-", "p_brand", F.col("stretch").cast("string")).alias("source_batch_id"), clinic.alias("clinic"), "services")))
    made.write.option("maxRecordsPerFile", 1).text(folder)
    return service_rows(read_payloads(spark, folder)).select("batch_id", "row_index", "external_id", "name", "category", "price", F.col("clinic.name").alias("clinic"), F.col("branch.name").alias("branch"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents)
SELECT doc_id, 'text' AS format, '' AS error, 0 AS truncated, count(*) FILTER (line <> '') AS text_block_count, CAST(coalesce(sum(length(line)), 0) AS BIGINT) AS chars FROM l GROUP BY 1""")
def text_documents(spark: SparkSession, d: str) -> DataFrame:
    """Texts read as documents of lines, whatever the length of a line, with what their metadata tells."""
    texts = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    read = documents.extract(texts, limits=documents.Limits(cell=1 << 31))
    chars = read.select("doc_id", F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"])).alias("chars"))
    told = documents.metadata(read).join(chars, "doc_id")
    return told.select(F.substring_index("doc_id", ".", 1).cast("long").alias("doc_id"), "format", F.coalesce("error", F.lit("")).alias("error"), F.col("truncated").cast("int").alias("truncated"), F.col("text_block_count").cast("long").alias("text_block_count"), "chars")


@query(f"""WITH p AS (SELECT *, p_brand || '-' || (p_partkey // {PAYLOAD_PARTS}) AS doc FROM part), n AS (SELECT *, row_number() OVER w AS i, dense_rank() OVER (PARTITION BY doc ORDER BY p_type) AS k FROM p WINDOW w AS (PARTITION BY doc ORDER BY p_type, p_partkey)),
big AS (SELECT doc FROM p GROUP BY 1 HAVING count(*) + count(DISTINCT p_type) >= 3)
SELECT doc, i + k AS row_number, CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_type AS section, CAST(k AS VARCHAR) AS section_number, p_type AS category, p_retailprice AS price, 2 AS duration_days FROM n JOIN big USING (doc)""")
def price_lists(spark: SparkSession, d: str) -> DataFrame:
    """Parts as HTML price lists with a section for each type, one for each brand and stretch of keys, read back as price rows."""
    own = Window.partitionBy("doc")
    p = table(spark, d, "part").withColumn("doc", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / PAYLOAD_PARTS).cast("string")))
    first = F.row_number().over(Window.partitionBy("doc", "p_type").orderBy("p_partkey")) == 1
    p = p.withColumns({"k": F.dense_rank().over(own.orderBy("p_type")), "first": first})
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = F.when(F.col("first"), row(F.concat(F.col("k").cast("string"), F.lit(". "), "p_type"), F.lit(""), F.lit(""), F.lit(""))).otherwise("")
    line = F.concat(head, row(F.col("p_partkey").cast("string"), F.col("p_name"), F.lit("2 дня"), F.col("p_retailprice").cast("string")))
    listed = p.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", "p_partkey", line.alias("line")))), lambda x: x["line"]), "").alias("body"))  # PAYLOAD_PARTS at most
    titles = F.lit("<table><tr><th>№</th><th>Наименование услуги</th><th>Срок</th><th>Цена</th></tr>")
    pages = listed.select(F.concat("doc", F.lit(".html")).alias("path"), F.concat(titles, "body", F.lit("</table>")).alias("content"))
    rows = profiles.price_rows(documents.cells(documents.extract(pages)), profiles.LAYOUTS["section_categories"])
    return money(rows.select(F.substring_index("doc_id", ".", 1).alias("doc"), "row_number", "code", "name", "section", "section_number", "category", "price", "duration_days"))


@query("SELECT p_partkey AS id, i AS row_number, 'A' || p_partkey AS code, p_name AS name, coalesce(CASE WHEN p_size % 4 > 0 THEN p_retailprice END, -1) AS price, CASE WHEN p_size % 4 > 0 THEN '' ELSE 'MISSING_PRICE' END AS error FROM (SELECT *, 1 AS i FROM part)")
def priced_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as items of a catalogue, one for a document; every fourth size has no price."""
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("item_index"), F.concat(F.lit("A"), "p_partkey").alias("code"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 > 0, F.concat(F.col("p_retailprice").cast("string"), F.lit(" тг"))).otherwise("по запросу").alias("price_raw"), F.lit(None).cast("string").alias("fee_raw"))
    rows = profiles.item_rows(items)
    return money(rows.select(F.col("doc_id").cast("long").alias("id"), "row_number", "code", "name", F.coalesce(F.col("price").cast("double"), F.lit(-1.0)).alias("price"), F.coalesce("error", F.lit("")).alias("error")))


@query("""SELECT o_orderkey AS id, replace(format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT)), ',', chr(160)) || chr(160) || '₸' AS price, '₽' || format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS BIGINT)) AS english,
CAST(day(o_orderdate) AS VARCHAR) || ' ' || (['янв.', 'февр.', 'мар.', 'апр.', 'мая', 'июн.', 'июл.', 'авг.', 'сент.', 'окт.', 'нояб.', 'дек.'])[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) || ' г.' AS day,
strftime(o_orderdate, '%b %-d, %Y, %H:%M') AS moment FROM orders""")
def shown_prices(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), X.price_text("o_totalprice").alias("price"), X.price_text("o_totalprice", "RUB", "en").alias("english"), X.date_text(at).alias("day"), X.date_text(at, "en", True).alias("moment"))
