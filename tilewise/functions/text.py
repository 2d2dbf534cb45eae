"""Strings, dates and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_text(html) -> Column:
    """HTML without scripts, styles and tags, white space as single spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))


def first_number(text, pattern: str) -> Column:
    """The first group of pattern as a number, thousands separators left out; null without a match."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), ",", "").try_cast("double")


# Patterns of published figures
INSTALLATIONS = r"(?i)(\d{1,3}(?:[,]\d{3})*|\d+)\s*(?:net[- ]metering)?\s*installations?"
MEGAWATTS = r"(?i)(\d{1,4}(?:\.\d+)?)\s*(?:MW|megawatts?)"


def verdict_class(text) -> Column:
    """The class of a reviewer's remark, by the first rule that holds."""
    t = F.lower(text)
    has = t.contains
    return (
        F.when(has("ground-mount") | has("ground mount"), "ground_mount").when(has("false positive"), "blue_roof_fp")
        .when(has("real rooftop solar") | has("confirmed"), "rooftop").when(has("blue") & has("roof") & ~has("real rooftop"), "blue_roof_fp").otherwise("unknown")
    )


def table_cells(line) -> Column:
    """Cells of a markdown table row."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def is_separator(line) -> Column:
    return line.rlike(r"^[\s|:-]*-[\s|:-]*$")


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")


def name_key(text) -> Column:
    """Letters and digits alone, in lower case: equal for spellings that differ in case and punctuation."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def name_variants(name) -> Column:
    """Sorted spellings of a place name: with and without City, Santa and Sta., Sto. and Santo."""
    city = F.when(name.endswith(" City"), F.regexp_replace(name, " City$", "")).otherwise(F.concat(name, F.lit(" City")))
    saint = F.when(name.startswith("Santa "), F.concat(F.lit("Sta. "), F.substring(name, 7, 1000))).when(name.startswith("Sto. "), F.concat(F.lit("Santo "), F.substring(name, 6, 1000))).otherwise(name)
    return F.array_sort(F.array_distinct(F.array(name, city, saint)))


def stratum(src) -> Column:
    """The region in a training source's name, or ncr."""
    found = F.regexp_extract(src, r"^reg(?:pos|fp|ground)_(.*)_[^_]*$", 1)
    return F.when(found == "", "ncr").otherwise(found)


def month_label(month) -> Column:
    """2026-07 as July 2026; anything else as it is."""
    return F.when(month.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.date_format(F.try_to_timestamp(F.concat(month, F.lit("-01"))), "MMMM yyyy")).otherwise(month)


def quarter_dates(quarter) -> tuple[Column, Column]:
    """First and last day of 2026Q2; null where the format is another."""
    ok = quarter.rlike(r"^\d{4}Q[1-4]$")
    year, q = F.substring(quarter, 1, 4).try_cast("int"), F.substring(quarter, 6, 1).try_cast("int")
    start = F.when(ok, F.make_date(year, q * 3 - 2, F.lit(1)))
    return start, F.last_day(F.add_months(start, 2))


def baseline_date(day, years: int = 1) -> Column:
    """The same day years before; 29 February becomes 28."""
    return F.add_months(day, -12 * years)


def address_label(*parts) -> Column:
    """The first three distinct parts that aren't empty."""
    kept = F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    return F.array_join(F.slice(kept, 1, 3), ", ")


def tag_is_solar(tags) -> Column:
    """Map tags that say photovoltaic generation."""
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    return (get("generator:source") == "solar") | (get("generator:method") == "photovoltaic") | ((get("power") == "generator") & get("generator:source").rlike("(?i)solar")) | ((get("power") == "plant") & (get("plant:source") == "solar"))


def is_ground_mount(tags) -> Column:
    get = lambda k: F.coalesce(tags[k], F.lit(""))
    return (get("location") == "ground") | (get("power") == "plant") | (get("plant:source") == "solar")


def building_type(tags) -> Column:
    """The building tag unless it is a bare yes; then amenity, then shop."""
    return F.coalesce(F.when(tags["building"] != "yes", tags["building"]), tags["amenity"], tags["shop"])


def hash_matches(content, prefix: str) -> Column:
    """Whether the SHA-256 of binary content starts with prefix."""
    return F.substring(F.sha2(content, 256), 1, len(prefix)) == prefix.lower()
