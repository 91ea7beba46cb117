"""Query plans over a star of prices, services, clinics and branches.

Inputs are DataFrames with these columns; extra ones may follow.
prices: clinic_id, branch_id, service_id, currency, price, observed_at, is_available.
services: service_id, service_name, category, canonical_name, service_active.
clinics: clinic_id, clinic_name, clinic_active.  branches: branch_id, city, region, branch_active.

Joins carry no hints: a dimension is broadcast when statistics show that it is small, and
shuffled with skew handling when it isn't.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.rules import age_days, freshness, half_even_mean
from ..functions.text import expand_query, normalize_city, normalize_name, normalize_text, plain_text, resolve_city
from ..operators import textindex


@dataclass(frozen=True)
class Star:
    prices: DataFrame
    services: DataFrame
    clinics: DataFrame
    branches: DataFrame
    #: Postings (gram, id) of services' names, canonical names and categories, and of clinics' names, if they are stored (see ``operators.textindex``).
    service_grams: DataFrame | None = None
    clinic_grams: DataFrame | None = None

    def joined(self) -> DataFrame:
        """All prices with their dimensions; filters on any column are pushed to its own table."""
        return self.prices.join(self.services, "service_id").join(self.clinics, "clinic_id").join(self.branches, "branch_id")

    def active(self) -> DataFrame:
        return self.joined().where("service_active and clinic_active and branch_active and is_available")


def _has(wildcards: bool, c: Column, term: str) -> Column:
    return c.like(f"%{term}%") if wildcards else c.contains(term)


def service_matches(q: str, wildcards: bool = False) -> Column:
    """Whether service, canonical or category name contains the query or a term that stands for it."""
    out = F.lit(False)
    for term in expand_query(q):
        for c in (F.lower("service_name"), F.lower("canonical_name"), F.lower("category"), normalize_name("service_name")):
            out = out | _has(wildcards, c, term)
    return out


def clinic_matches(q: str, wildcards: bool = False) -> Column:
    """Whether the clinic's name contains the query itself."""
    return _has(wildcards, F.lower("clinic_name"), q.strip().lower())


def name_matches(q: str, wildcards: bool = False) -> Column:
    return clinic_matches(q, wildcards) | service_matches(q, wildcards)


def _matching(star: Star, q: str) -> DataFrame:
    """Active prices whose service or clinic matches.

    Names are looked at once for each service and clinic, not for each price.  With postings only the candidates are looked
    at, and prices are reached from the services and the clinics that match, each by its own join.
    """
    if star.service_grams is None or star.clinic_grams is None:
        told = replace(star, services=star.services.withColumn("_service", service_matches(q)), clinics=star.clinics.withColumn("_clinic", clinic_matches(q)))
        return told.active().where("_service or _clinic").drop("_service", "_clinic")
    asked = textindex.candidates(star.service_grams, *(expand_query(q))).withColumnRenamed("id", "service_id")
    services = star.services.join(asked, "service_id", "left_semi").where(service_matches(q))
    clinics = star.clinics.join(textindex.candidates(star.clinic_grams, q.strip()).withColumnRenamed("id", "clinic_id"), "clinic_id", "left_semi").where(clinic_matches(q))
    by_service = replace(star, services=services).active()
    by_clinic = replace(star, clinics=clinics, prices=star.prices.join(services.select("service_id"), "service_id", "left_anti")).active()
    return by_service.unionByName(by_clinic.select(*by_service.columns))


def city_is(city: str) -> Column:
    """Equality with a known city, both sides normalised; else a substring of the city's name."""
    known = resolve_city(city)
    return normalize_city("city") == known if known else F.lower("city").contains(city.lower())


def filtered(star: Star, q: str | None = None, city: str | None = None, category: str | None = None, low: float | None = None, high: float | None = None, service_id: int | None = None, canonical: str | None = None) -> DataFrame:
    """Active prices that fit: service_id before canonical name before query text, and all other filters given."""
    if service_id is not None:
        rows = star.active().where(F.col("service_id") == service_id)
    elif canonical is not None:
        rows = star.active().where(F.col("canonical_name") == canonical)
    else:
        rows = _matching(star, q) if q else star.active()
    if city:
        rows = rows.where(city_is(city))
    if category:
        rows = rows.where(normalize_text("category") == plain_text(category))
    if low is not None:
        rows = rows.where(F.col("price") >= low)
    if high is not None:
        rows = rows.where(F.col("price") <= high)
    return rows


ID = ("clinic_id", "branch_id", "service_id", "currency")


#: Orders by name: columns with whether they fall; ``name`` stands for the column a caller sorts names by.  Unknown names and dates come last.
SORTS = {"relevance": (("name", False), ("price", False)), "price_asc": (("price", False), ("name", False)), "price_desc": (("price", True), ("name", False)), "updated_desc": (("observed_at", True), ("name", False))}


def _keys(sort: str, name: str) -> list[tuple[str, bool]]:
    """A total order: the asked one, then the name, then the price's identity."""
    return [(name if c == "name" else c, falls) for c, falls in SORTS[sort]] + [(c, False) for c in ID]


def ordered(rows: DataFrame, sort: str, name: str = "service_name") -> DataFrame:
    """Total orders: the asked one, then the name, then the price's identity."""
    return rows.orderBy(*[F.desc_nulls_last(c) if falls else F.asc_nulls_last(c) for c, falls in _keys(sort, name)])


def beyond(keys: list[tuple[str, bool]], cursor: list[object]) -> Column:
    """Whether a row comes after the one with these values in an order of (column, whether it falls), unknown values last."""
    out, same = F.lit(False), F.lit(True)
    for (c, falls), value in zip(keys, cursor):
        if value is not None:
            out = out | (same & F.coalesce((F.col(c) < F.lit(value)) if falls else (F.col(c) > F.lit(value)), F.lit(True)))
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return out


def cursor_of(row: Row, sort: str = "relevance", name: str = "service_name") -> list[object]:
    """Where the page after this row begins."""
    return [row[c] for c, _ in _keys(sort, name)]


def search(star: Star, q: str, sort: str = "relevance", limit: int = 20, offset: int = 0, now: Column | None = None, after: list[object] | None = None, **filters: object) -> DataFrame:
    """One page of results, with freshness if ``now`` is given.

    ``after``, the ``cursor_of`` the last row of a page, gives the next page at the cost of a first one: it is a
    condition on the rows, while an offset sorts all rows up to the page.
    """
    if not 1 <= limit <= 100 or offset < 0 or (offset and after is not None):
        raise ValueError("limit must be 1 to 100, offset not negative, and no offset beside a cursor")
    rows = filtered(star, q, **filters)
    if after is not None:
        rows = rows.where(beyond(_keys(sort, "service_name"), after))
    page = ordered(rows, sort)
    page = (page.offset(offset) if offset else page).limit(limit)
    return with_freshness(page, now) if now is not None else page


def with_freshness(rows: DataFrame, now: Column) -> DataFrame:
    age = age_days("observed_at", F.lit(None).cast("date"), now)
    return rows.withColumn("age_days", age).withColumn("freshness", freshness("age_days"))


def nested(rows: DataFrame) -> DataFrame:
    """Result rows as nested records: service, clinic, branch, price."""
    pack = lambda name, *cs: F.struct(*cs).alias(name)
    return rows.select(pack("service", "service_id", "service_name", "category"), pack("clinic", "clinic_id", "clinic_name"), pack("branch", "branch_id", "city"), pack("price", "price", "currency", "observed_at"))


def price_stats(rows: DataFrame, *by: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """min, max, mean to cents (ties to even) and count, and ``more`` aggregates in the same pass; empty input gives a row of nulls and 0 without ``by``."""
    return rows.groupBy(*by).agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), half_even_mean(F.sum("price"), F.count("price")).alias("average_price"), F.count("*").alias("count"), *more)


def categories(star: Star) -> DataFrame:
    """Categories with their number of services, empty ones too."""
    return star.services.groupBy("category").agg(F.count_distinct(F.when(F.col("service_active"), F.col("service_id"))).alias("service_count"))


def category_counts(categories_: DataFrame, services: DataFrame) -> DataFrame:
    """Each row of a category table (category) with its number of active services, 0 for an empty one."""
    counted = services.where("service_active").groupBy("category").agg(F.count("service_id").alias("service_count"))
    return categories_.join(counted, "category", "left").na.fill(0, ["service_count"])


def cities(star: Star) -> DataFrame:
    """Cities with their numbers of branches and of clinics that have an available price."""
    priced = star.prices.where("is_available").select("branch_id").distinct().withColumn("priced", F.lit(True))
    return star.branches.where("branch_active").join(priced, "branch_id", "left").groupBy("city").agg(F.count_distinct("branch_id").alias("branch_count"), F.count_if(F.coalesce("priced", F.lit(False))).alias("priced_count"))


def clinics(star: Star, city: str | None = None, category: str | None = None) -> DataFrame:
    """Clinics with numbers of branches and services and the latest date; each side is counted before it is joined, so nothing fans out.

    A city is meant exactly here, whatever its case: aliases are not resolved.
    """
    chosen = star.clinics.where("clinic_active")
    services = star.prices
    if city or category:
        asked = star
        if city:  # each filter first meets prices by itself, so that few of them go on to the other joins
            here = star.branches.where(F.lower("city") == city.lower())
            asked = replace(asked, branches=here, prices=asked.prices.join(here.select("branch_id"), "branch_id", "left_semi"))
        if category:
            such = star.services.where(F.col("category") == category)
            asked = replace(asked, services=such, prices=asked.prices.join(such.select("service_id"), "service_id", "left_semi"))
        chosen = chosen.join(asked.joined().select("clinic_id").distinct(), "clinic_id", "left_semi")
        services = services.join(chosen.select("clinic_id"), "clinic_id", "left_semi")  # others are not counted
    # two plain counts of distinct pairs, each partly aggregated before it moves, in place of two distinct counts that would multiply every price
    by_service = services.groupBy("clinic_id", "service_id").agg(F.max("observed_at").alias("seen")).groupBy("clinic_id").agg(F.count("service_id").alias("service_count"), F.max("seen").alias("last_updated"))
    by_branch = services.select("clinic_id", "branch_id").distinct().groupBy("clinic_id").agg(F.count("branch_id").alias("branch_count"))
    counted = by_service.join(by_branch, "clinic_id").select("clinic_id", "service_count", "branch_count", "last_updated")
    return chosen.join(counted, "clinic_id", "left").na.fill(0, ["service_count", "branch_count"])


def service_detail(star: Star, service_id: int) -> DataFrame:
    return star.prices.where(F.col("service_id") == service_id).join(star.clinics, "clinic_id").join(star.branches, "branch_id")


def clinic_detail(star: Star, clinic_id: int) -> DataFrame:
    return star.prices.where(F.col("clinic_id") == clinic_id).join(star.services, "service_id")


#: The order of history pages, newest first.
HISTORY_KEYS = [("observed_at", True), ("batch_id", True), ("row_index", True), *((c, False) for c in (*ID, "price"))]


def history_page(history: DataFrame, page: int, size: int, since: Column | None = None, clinic_id: int | None = None, service_id: int | None = None, after: Row | None = None) -> DataFrame:
    """One page of history, newest first, with has_more on every row: one row more than asked is looked at.

    With ``after``, the last row of the page before, no row of earlier pages is sorted, and ``page`` is not used.
    """
    if since is not None:
        history = history.where(F.col("observed_at") >= since)
    if clinic_id is not None:
        history = history.where(F.col("clinic_id") == clinic_id)
    if service_id is not None:
        history = history.where(F.col("service_id") == service_id)
    order = [F.desc_nulls_last(c) if falls else F.asc_nulls_last(c) for c, falls in HISTORY_KEYS]
    if after is not None:
        history = history.where(beyond(HISTORY_KEYS, [after[c] for c, _ in HISTORY_KEYS]))
        page = 1
    rows = history.orderBy(*order).offset((page - 1) * size).limit(size + 1)
    n = F.row_number().over(Window.orderBy(*order))  # over size + 1 rows
    return rows.withColumn("_n", n).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size).where(F.col("_n") <= size).drop("_n")


def with_names(page: DataFrame, star: Star) -> DataFrame:
    """Rows of history with the names of their service, clinic and branch; rows of a page are few when they are joined."""
    return page.join(star.services.select("service_id", "service_name", "category"), "service_id").join(star.clinics.select("clinic_id", "clinic_name"), "clinic_id").join(star.branches.select("branch_id", "city"), "branch_id")


def branches_of(branches: DataFrame, clinic_id: int | None = None) -> DataFrame:
    """Branches, those of one clinic if asked, the default one first, then by id."""
    rows = branches if clinic_id is None else branches.where(F.col("clinic_id") == clinic_id)
    return rows.orderBy(F.desc_nulls_last("is_default"), "branch_id")


def history_stats(changes: DataFrame) -> DataFrame:
    """Changes, observations, first and last time, and prices, in one pass over filtered rows."""
    return changes.agg(
        F.count_if(F.col("status") != "unchanged").alias("change_count"),
        F.count("*").alias("observation_count"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        half_even_mean(F.sum("price"), F.count("price")).alias("average_price"),
    )


def autocomplete(canonical: DataFrame, synonyms: DataFrame, queue: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Suggestions of three tiers, canonical names, synonym keys and open queue names, each text once, up to ``limit``.

    canonical: text, category.  synonyms: text.  queue: text, category, occurrence_count, status.
    """
    key = " ".join(q.lower().split())
    tiers = [
        canonical.select("text", "category", F.lit(1).alias("tier"), F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("weight")),
        synonyms.select("text", F.lit(None).cast("string").alias("category"), F.lit(2).alias("tier"), F.lit(0.9).alias("confidence"), F.lit(0).cast("long").alias("weight")),
        queue.where("status = 'open'").select("text", "category", F.lit(3).alias("tier"), F.lit(0.5).alias("confidence"), F.col("occurrence_count").cast("long").alias("weight")),
    ]
    hits = None
    for t in tiers:
        t = t.where(F.lower("text").contains(key))
        hits = t if hits is None else hits.unionByName(t)
    best = hits.groupBy("text").agg(F.min(F.struct("tier", (-F.col("weight")).alias("minus"), F.coalesce("category", F.lit("")).alias("category"), "confidence")).alias("b"))
    return best.select("text", "b.tier", "b.confidence", "b.category", (-F.col("b.minus")).alias("weight")).orderBy("tier", F.desc("weight"), "text").limit(max(limit, 0))


def city_aliases_reversed(aliases: DataFrame) -> DataFrame:
    """Each canonical city with its sorted aliases (form, city)."""
    return aliases.groupBy("city").agg(F.array_sort(F.collect_set("form")).alias("aliases"))


def rollup_regions(star: Star) -> DataFrame:
    """An extension: active prices counted by region and city, with subtotals and the total."""
    return star.active().rollup("region", "city").agg(F.count("*").alias("count"), F.min("price").alias("min_price"))
