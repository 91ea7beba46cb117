"""Price rows from table cells by declarative profiles: one extractor for all layouts of price lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_contrast, is_note, is_section, parse_days, parse_price, section_name, section_number, weight_limit
from ..operators.state import carry_forward
from .documents import row_cells


@dataclass(frozen=True)
class Layout:
    """How a source writes its price lists.

    ``roles``: words in headings by role (code, name, unit, price, duration); the last column
    whose heading has one takes the role, or the first for roles in ``first_wins``.
    """

    # Words of headings.
    name: tuple[str, ...] = ("наименование", "услуг", "исследовани")
    price: tuple[str, ...] = ("цена", "стоимость", "тариф")
    roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"code": ("№", "п/п", "номер", "порядковый"), "unit": ("ед.", "единица"), "duration": ("срок", "дни", "день", "время")})
    first_wins: tuple[str, ...] = ()
    min_rows: int = 3
    zero_is_a_price: bool = False
    sections: bool = False
    parents: bool = False
    notes: bool = False
    #: Where the category comes from: a constant, ``section``, or the heading before the table.
    category: str | None = None
    heading_is_category: bool = False
    default_category: str = "Лабораторные исследования"
    #: Keep parity with the rule that a note may be taken as a section and parents outlive sections.
    strict_parity: bool = False


#: Layouts by what is particular to them.
LAYOUTS = {
    "days": Layout(zero_is_a_price=True, category="Лабораторные исследования"),
    "sections": Layout(sections=True, category="Диагностика"),
    "section_categories": Layout(sections=True),
    "two_tariffs": Layout(price=("рк", "граждан"), first_wins=("price",), sections=True),
    "city_hosts": Layout(category="Диагностика"),
    "parents": Layout(sections=True, parents=True, notes=True, min_rows=10),
    "many_tables": Layout(heading_is_category=True),
    "short_tables": Layout(heading_is_category=True, min_rows=2),
}


def _role(text: Column, layout: Layout) -> Column:
    low = F.lower(text)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    out = F.when(has(layout.roles["code"]), "code") if "code" in layout.roles else F.when(F.lit(False), "")
    out = out.when(has(layout.name), "name")
    for role, words in layout.roles.items():
        if role != "code":
            out = out.when(has(words), role)
    return out.when(has(layout.price), "price")


def column_roles(cells: DataFrame, layout: Layout) -> DataFrame:
    """(doc_id, table_index, role, col_index) by the headings of the first header row."""
    top = F.min("row_index").over(Window.partitionBy("doc_id", "table_index"))
    heads = cells.where("row_is_header").withColumn("_top", top).where("row_index = _top").withColumn("role", _role(F.col("text"), layout)).where("role is not null")
    at = F.when(F.col("role").isin(*layout.first_wins or ("",)), F.min("col_index")).otherwise(F.max("col_index"))
    return heads.groupBy("doc_id", "table_index", "role").agg(at.alias("col_index"))


def price_rows(cells: DataFrame, layout: Layout) -> DataFrame:
    """Price rows of all tables that have name and price columns and enough rows: doc_id, table_index, row_number, code, name, unit, category, section, price, duration_days, flags, cells."""
    roles = column_roles(cells, layout).groupBy("doc_id", "table_index").pivot("role", ["code", "name", "unit", "price", "duration"]).agg(F.max("col_index"))
    roles = roles.where("name is not null and price is not null").select("doc_id", "table_index", *[F.col(r).alias(f"at_{r}") for r in ("code", "name", "unit", "price", "duration")])
    rows = row_cells(cells).where("not is_header").join(roles, ["doc_id", "table_index"])
    table = Window.partitionBy("doc_id", "table_index")
    rows = rows.withColumn("_n", F.count("*").over(table)).where(F.col("_n") >= layout.min_rows)
    rows = rows.withColumn("row_number", F.row_number().over(table.orderBy("row_index")))
    text = lambda r: F.trim(F.coalesce(F.get("cells", F.col(f"at_{r}")), F.lit("")))
    note = is_note(F.col("cells")) if layout.notes else F.lit(False)
    lone_note = F.lower(F.get("cells", F.lit(0))).contains("примечание") if layout.notes and not layout.strict_parity else F.lit(False)
    section = (is_section(F.col("cells")) & ~lone_note) if layout.sections else F.lit(False)
    rows = rows.withColumn("_section", section).withColumn("_note", (note | lone_note) & ~section)
    head = F.when(F.col("_section"), F.trim(F.get("cells", F.lit(0))))
    order = ["doc_id", "table_index"], ["row_index"]
    rows = rows.withColumn("_head", carry_forward(head, *order))
    name = text("name")
    parent = ~F.col("_section") & ~F.col("_note") & (text("price") == "") & name.endswith(":") if layout.parents else F.lit(False)
    rows = rows.withColumn("_parent", parent)
    spell = ["doc_id", "table_index"] if layout.strict_parity else ["doc_id", "table_index", "_head"]
    prefix = carry_forward(F.when(F.col("_parent"), F.regexp_replace(name, r":\s*$", "")), spell, ["row_index"])
    rows = rows.withColumn("_prefix", prefix).where("not _section and not _note and not _parent")
    price = parse_price(text("price"))
    fits = (price >= 0) if layout.zero_is_a_price else (price > 0)
    category = F.lit(layout.category) if layout.category else F.coalesce(F.col("heading"), F.lit(layout.default_category)) if layout.heading_is_category else F.coalesce(section_name("_head"), F.lit(layout.default_category))
    full = F.concat_ws(" ", "_prefix", name)
    return rows.where((name != "") & fits).select(
        "doc_id",
        "table_index",
        "row_number",
        F.when(F.col("at_code").isNotNull(), text("code")).alias("code"),
        full.alias("name"),
        F.when(F.col("at_unit").isNotNull(), text("unit")).alias("unit"),
        category.alias("category"),
        section_name("_head").alias("section"),
        section_number("_head").alias("section_number"),
        text("price").alias("price_raw"),
        price.alias("price"),
        F.when(F.col("at_duration").isNotNull(), parse_days(text("duration"))).alias("duration_days"),
        has_contrast(full).alias("has_contrast"),
        weight_limit(full).alias("weight_limit"),
        "cells",
    )


def item_rows(items: DataFrame) -> DataFrame:
    """Catalogue items with price and separate fee; ``error`` is MISSING_PRICE where there is none."""
    price = parse_price("price_raw")
    return items.select("doc_id", (F.col("item_index") + 1).alias("row_number"), "code", "name", "price_raw", price.alias("price"), parse_price("fee_raw").alias("fee"), F.when(price.isNull(), "MISSING_PRICE").alias("error"))
