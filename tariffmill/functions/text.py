"""Text normalisation, vocabulary look-ups and parsers as column functions.

Each ``plain_*`` function is the same rule for one Python value: parameters of queries are
resolved on the driver with it, and tests hold the column form against it.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- normalisation


def collapse_spaces(c: Column | str) -> Column:
    """Trimmed, with each run of white space (also no-break spaces) as one space."""
    return F.trim(F.regexp_replace(_column(c), r"(?U)\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Lower case, trimmed, one space between words, ё as е; null as the empty string."""
    return collapse_spaces(F.replace(F.lower(F.coalesce(_column(c), F.lit(""))), F.lit("ё"), F.lit("е")))


def plain_text(value: str | None) -> str:
    return " ".join((value or "").lower().replace("ё", "е").split())


def normalize_name(c: Column | str) -> Column:
    """A service name: dashes unified, marks but ``-/()`` dropped, set phrases replaced in order."""
    out = F.regexp_replace(normalize_text(c), "[–—]", "-")
    out = collapse_spaces(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}_\s\-/()]", " "))
    for phrase, short in vocab.PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(short))
    return F.trim(out)


def plain_name(value: str | None) -> str:
    out = re.sub("[–—]", "-", plain_text(value))
    out = " ".join("".join(ch if ch.isspace() or ch in "_-/()" or unicodedata.category(ch)[0] in "LMN" else " " for ch in out).split())
    for phrase, short in vocab.PHRASES:
        out = out.replace(phrase, short)
    return out.strip()


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalize_city(c: Column | str) -> Column:
    """The canonical city of an alias; other cities just normalised."""
    key = normalize_text(c)
    return F.coalesce(_lookup(vocab.city_aliases(), key), key)


def plain_city(value: str | None) -> str:
    key = plain_text(value)
    return vocab.city_aliases().get(key, key)


def resolve_city(value: str | None) -> str | None:
    """The canonical city that a search parameter means: an alias, or else the first alias that contains it or that it contains."""
    key = plain_text(value)
    if not key:
        return None
    aliases = vocab.city_aliases()
    return aliases.get(key) or next((city for form, city in aliases.items() if key in form or form in key), None)


def resolve_city_column(c: Column | str) -> Column:
    key = normalize_text(c)
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.lit(v).alias("city")) for k, v in vocab.city_aliases().items()])
    near = F.filter(forms, lambda f: f["form"].contains(key) | key.contains(f["form"]))
    return F.when(key != "", F.coalesce(_lookup(vocab.city_aliases(), key), F.get(near, F.lit(0))["city"]))


def qualifiers(c: Column | str) -> Column:
    """The sorted names of the qualifier groups whose words a name contains."""
    text = normalize_text(c)
    found = []
    for group, words in vocab.QUALIFIERS.items():
        has = F.lit(False)
        for w in words:
            has = has | text.contains(w)
        found.append(F.when(has, F.lit(group)))
    return F.array_compact(F.array(*found))


def plain_qualifiers(value: str | None) -> list[str]:
    text = plain_text(value)
    return [g for g, words in vocab.QUALIFIERS.items() if any(w in text for w in words)]


@lru_cache(maxsize=1)
def synonym_index() -> dict[str, str]:
    """Normalised name or synonym to normalised canonical name; canonical names always stand for themselves."""
    index: dict[str, str] = {}
    for canonical, synonyms in vocab.SERVICE_SYNONYMS.items():
        name = plain_name(canonical)
        index[name] = name
        for s in synonyms:
            index.setdefault(plain_name(s), name)
    return index


def synonym_of(c: Column | str) -> Column:
    return _lookup(synonym_index(), normalize_name(c))


def expand_query(value: str) -> list[str]:
    """All terms of the group a query belongs to, normalised; or the query alone."""
    name = plain_name(value)
    for group in vocab.SEARCH_GROUPS:
        terms = list(dict.fromkeys(map(plain_name, group)))
        if name in terms:
            return terms
    return [name]


def plain_slug(value: str | None) -> str:
    flat = unicodedata.normalize("NFKD", (value or "").lower().strip().replace("ё", "е"))
    flat = "".join(ch for ch in flat if not unicodedata.combining(ch))
    return re.sub("[^a-z0-9а-я]+", "-", flat).strip("-") or "item"


@F.pandas_udf(T.StringType())
def slugify(values: pd.Series) -> pd.Series:
    """Lower case, accents dropped, runs of other characters as one dash; ``item`` if nothing is left.  A UDF, as Spark has no Unicode decomposition."""
    known = {v: plain_slug(v) for v in values.unique()}
    return values.map(known.get)


# -- parsers


def parse_price(c: Column | str) -> Column:
    """The digits of a price text as decimal(20,2): commas and signs go; null without digits or with two points."""
    kept = F.replace(F.regexp_replace(F.coalesce(_column(c), F.lit("")), r"[^\p{Nd}.,]", ""), F.lit(","), F.lit(""))
    return F.when(kept.rlike(r"^(\d+\.?\d*|\.\d+)$"), kept).try_cast("decimal(20,2)")


def plain_price(value: str | None) -> Decimal | None:
    kept = re.sub(r"[^\d.,]", "", value or "").replace(",", "")
    try:
        return Decimal(kept) if kept else None
    except InvalidOperation:
        return None


def parse_days(c: Column | str) -> Column:
    """The first whole number of a text if it is 1 to 365."""
    n = F.regexp_extract(F.coalesce(_column(c), F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.when(n.between(1, 365), n)


def days_to_minutes(c: Column | str) -> Column:
    return _column(c) * 1440


def weight_limit(c: Column | str) -> Column:
    """The stretch of a name that limits weight, or null."""
    found = F.regexp_extract(F.lower(_column(c)), r"вес\s+(?:от\s+)?(\d+)\s*(?:кг)?", 0)
    return F.when(found != "", found)


def has_contrast(c: Column | str) -> Column:
    return F.lower(_column(c)).contains("контраст")


def city_from_path(url: Column | str, default: str = "Алматы") -> Column:
    """The city named by a part of a URL's path."""
    low, out = F.lower(_column(url)), F.lit(default)
    for part, city in reversed(vocab.URL_CITIES.items()):
        out = F.when(low.contains(f"/{part}/"), city).otherwise(out)
    return out


def city_from_host(url: Column | str, domain: str, cities: list[str]) -> Column:
    """The sub-domain of ``domain`` that names a city, else ``unknown``."""
    low, out = F.lower(_column(url)), F.lit("unknown")
    for city in reversed(cities):
        out = F.when(low.contains(f"{city}.{domain}"), city).otherwise(out)
    return out


def is_section(cells: Column) -> Column:
    """Whether a row of cells is a heading: one cell of more than two characters, the others blank."""
    first = F.trim(F.get(cells, F.lit(0)))
    rest = F.forall(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda x: F.trim(x) == "")
    return (F.size(cells) >= 1) & (F.length(first) > 2) & rest


def section_number(c: Column | str) -> Column:
    return F.regexp_extract(_column(c), r"^(\d+)", 1)


def section_name(c: Column | str) -> Column:
    """A heading without its number and without a dash at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(_column(c), r"^\d+[\.\)]\s*", ""), r"\s*[-—]\s*$", ""))


def is_note(cells: Column, words: tuple[str, ...] = ("примечание", "cito", "оплачивается")) -> Column:
    text, out = F.lower(F.array_join(cells, " ")), F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return (F.size(cells) >= 2) & out


def display_name(ru: Column | str, en: Column | str, kk: Column | str, raw: Column | str) -> Column:
    """The first name that isn't empty, Russian before English before Kazakh."""
    return F.coalesce(*[F.nullif(_column(c), F.lit("")) for c in (ru, en, kk)], _column(raw))


def shown_name(status: Column | str, source_name: Column | str, canonical: Column | str) -> Column:
    """Unmatched services show their own normalised name instead of the placeholder's."""
    return F.when(_column(status) == "unmatched", normalize_name(source_name)).otherwise(_column(canonical))


def row_id(source: Column | str, number: Column | str) -> Column:
    return F.format_string("%s_row_%03d", _column(source), _column(number))


def map_link(address: Column | str, base: str = "https://maps.example.org/?q=") -> Column:
    return F.concat(F.lit(base), F.url_encode(_column(address)))


#: Signs of currencies, short names of months, and what stands for an unknown value.
SIGNS = {"KZT": "₸", "RUB": "₽", "USD": "$", "EUR": "€"}
MONTHS = {
    "ru": ("янв.", "февр.", "мар.", "апр.", "мая", "июн.", "июл.", "авг.", "сент.", "окт.", "нояб.", "дек."),
    "en": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
}
UNKNOWN = "—"


def price_text(value: Column | str, currency: Column | str = "KZT", locale: str = "ru", fallback: str = UNKNOWN) -> Column:
    """A price in whole units as people read it (half a unit counts up): ``1 450 ₸`` in Russian, ``₸1,450`` in English; text that is no number stands as it is, with its currency.

    ``currency`` is a column, or the code of all prices.
    """
    code = F.lit(currency) if isinstance(currency, str) and currency.isupper() else _column(currency)
    sign = code
    for name, mark in SIGNS.items():
        sign = F.when(code == name, mark).otherwise(sign)
    plain = _column(value)
    amount = plain.try_cast("decimal(20,6)")
    grouped = F.format_number(F.round(amount, 0), 0)
    shown = F.concat(F.replace(grouped, F.lit(","), F.lit("\xa0")), F.lit("\xa0"), sign) if locale == "ru" else F.concat(F.when(F.length(sign) > 1, F.concat(sign, F.lit("\xa0"))).otherwise(sign), grouped)
    return F.when(plain.isNull(), fallback).when(amount.isNull(), F.concat(plain.cast("string"), F.lit(" "), code)).otherwise(shown)


def date_text(value: Column | str, locale: str = "ru", with_time: bool = False, fallback: str = UNKNOWN) -> Column:
    """A date with a short month: ``5 нояб. 2001 г.`` in Russian, ``Nov 5, 2001`` in English, and the time if asked."""
    at = _column(value).try_cast("timestamp")
    month = F.element_at(F.array(*map(F.lit, MONTHS[locale])), F.month(at))
    day, year, clock = F.dayofmonth(at).cast("string"), F.year(at).cast("string"), F.date_format(at, "HH:mm")
    shown = F.concat(day, F.lit(" "), month, F.lit(" "), year, F.lit(" г.")) if locale == "ru" else F.concat(month, F.lit(" "), day, F.lit(", "), year)
    return F.coalesce(F.concat(shown, F.lit(", "), clock) if with_time else shown, F.lit(fallback))


def opening_hours(lines: Column) -> Column:
    """The first seven lines joined."""
    return F.array_join(F.slice(lines, 1, 7), "; ")


def host_of(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.try_parse_url(_column(url), F.lit("HOST")), r"\.$", ""))


def is_public_ipv4(host: Column | str) -> Column:
    """Whether a host that is an IPv4 address lies outside private and reserved ranges; null for names."""
    parts = F.transform(F.split(_column(host), r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.when(_column(host).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~private)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two normalised names; a UDF, as Spark's edit distances measure something else."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def record_hash(records: pd.Series) -> pd.Series:
    """SHA-256 of canonical JSON: sorted keys, no spaces, characters kept; text that isn't JSON counts as a JSON string."""
    import hashlib
    import json

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            told = json.loads(text)
        except ValueError:
            told = text
        flat = json.dumps(told, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(flat.encode()).hexdigest()

    return records.map(one)
