"""Text and list helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters stripped from both ends of a typed item.
WHITESPACE = " \t\n\r\x0b\x0c"

MEDS_ITEM = "struct<name:string,dosage:string>"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    return F.when(strip(value) != "", value)


def split_list(value: Column) -> Column:
    """H1: comma list -> array of stripped, non-empty items (null text -> empty array)."""
    items = F.filter(F.transform(F.split(value, ","), strip), lambda item: item != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def parse_meds(value: Column) -> Column:
    """H2: JSON list -> array of ``{name, dosage}``; null unless the text is a JSON list.

    Goes through the variant type, which rejects broken JSON and tells a list from a
    bare object. Items that are not objects with a name are dropped.
    """
    # Only text bracketed like a list is parsed: a failed parse costs far more than a look,
    # and the parser itself would let text after the closing bracket pass.
    listed = F.when(strip(value).startswith("[") & strip(value).endswith("]"), value)
    parsed = F.try_parse_json(listed)
    # A clean list converts in one step; one with odd items is taken apart item by item.
    clean = F.try_variant_get(parsed, "$", f"array<{MEDS_ITEM}>")
    mixed = F.transform(
        F.try_variant_get(parsed, "$", "array<variant>"),
        lambda v: F.struct(
            F.try_variant_get(v, "$.name", "string").alias("name"),
            F.try_variant_get(v, "$.dosage", "string").alias("dosage"),
        ),
    )
    return F.filter(F.coalesce(clean, mixed), lambda p: p["name"].isNotNull())


def med_names(value: Column) -> Column:
    """Names inside the JSON list; empty array when there is no valid list."""
    names = F.transform(parse_meds(value), lambda p: p["name"])
    return F.coalesce(names, F.array().cast("array<string>"))


def is_json(value: Column) -> Column:
    """Whether the text is valid JSON; parsed only if its first character allows that."""
    opens = strip(value).rlike(r'^([\[{"0-9-]|true$|false$|null$)')
    return F.try_parse_json(F.when(opens, value)).isNotNull()


def to_meds_json(items: Column) -> Column:
    """H3: array of ``{name, dosage}`` -> JSON text."""
    return F.to_json(items)


def effective_medications(medications: Column, medication: Column, dosage: Column) -> Column:
    """The JSON list when it has items, else one item from the legacy text pair."""
    parsed = parse_meds(medications)
    legacy = F.array(
        F.struct(medication.alias("name"), F.coalesce(dosage, F.lit("")).alias("dosage"))
    ).cast(f"array<{MEDS_ITEM}>")
    none = F.array().cast(f"array<{MEDS_ITEM}>")
    return (
        F.when(F.size(F.coalesce(parsed, none)) > 0, parsed)
        .when(F.coalesce(medication, F.lit("")) != "", legacy)
        .otherwise(none)
    )


def medication_label(items: Column) -> Column:
    """``name (dosage)`` labels joined by a comma."""
    return F.array_join(
        F.transform(
            items,
            lambda m: F.when(
                F.coalesce(m["dosage"], F.lit("")) != "", F.concat(m["name"], F.lit(" ("), m["dosage"], F.lit(")"))
            ).otherwise(m["name"]),
        ),
        ", ",
    )


def rename_in_list(value: Column, old: Column, new: Column) -> Column:
    """Replace list items equal to ``old``; text without such an item is untouched.

    Blank items survive a rewrite, as they do in the source text.
    """
    items = F.transform(F.split(value, ","), strip)
    renamed = F.transform(items, lambda item: F.when(item == old, strip(new)).otherwise(item))
    return F.when(F.array_contains(items, old), F.array_join(renamed, ", ")).otherwise(value)


def loc_parse(value: Column) -> tuple[Column, Column]:
    """``"lat,lon"`` -> two doubles; anything but two parts gives nulls."""
    parts = F.split(value, ",")
    two = F.size(parts) == 2
    return (
        F.when(two, F.get(parts, F.lit(0)).try_cast("double")),
        F.when(two, F.get(parts, F.lit(1)).try_cast("double")),
    )
