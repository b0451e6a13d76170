"""QR payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.text import blank_to_null, digits

_PAIR = r"(?U)(\w+)\s*[=:]\s*([^;\n]+)"
#: Fields that are taken over by name.
PASSED = (
    "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price",
    "action_price_qr", "action_code_qr",
)


def _last_of_key(keys: Column, values: Column) -> Column:
    """A map of two arrays; of equal keys the last value stays, in the first one's place."""
    distinct = F.array_distinct(keys)
    back = F.reverse(keys)
    at = lambda k: F.size(keys) - F.array_position(back, k).cast("int") + 1
    return F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(values, at(k))))


def parse(raw: Column) -> Column:
    """Map of a payload: a JSON object, else ``key=value`` pairs, else fields by ``|``, else ``raw``."""
    text = F.trim(raw)
    object_ = F.when(text.rlike(r"^\{") & text.rlike(r"\}$"), F.from_json(raw, "map<string,string>", {"allowSingleQuotes": "false"}))
    keys = F.transform(F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(1)), lambda k: F.trim(k))
    values = F.transform(F.regexp_extract_all(raw, F.lit(_PAIR), F.lit(2)), lambda v: F.trim(v))
    fields = F.split(raw, r"\|")
    names = F.transform(F.sequence(F.lit(0), F.size(fields) - 1), lambda i: F.concat(F.lit("field_"), i.cast("string")))
    empty = F.create_map().cast("map<string,string>")
    return (
        F.when(raw.isNull() | (raw == ""), empty)
        .when(object_.isNotNull(), object_)
        .when(F.size(keys) > 0, _last_of_key(keys, values))
        .when(F.size(fields) > 1, F.map_from_arrays(names, F.transform(fields, lambda f: F.trim(f))))
        .otherwise(F.create_map(F.lit("raw"), raw))
    )


def prices(qr: Column) -> Column:
    """Up to four prices: from keys about price or cost, or else from the raw text."""
    number = "([0-9]+[.,][0-9]+)"
    keyed = F.filter(F.map_entries(qr), lambda e: F.lower(e["key"]).rlike("price|cost"))
    named = F.array_compact(F.transform(keyed, lambda e: F.replace(blank_to_null(F.regexp_extract(e["value"], number, 1)), F.lit(","), F.lit("."))))
    raw = F.coalesce(F.regexp_extract_all(F.coalesce(qr["raw"], F.lit("")), F.lit(number), F.lit(1)), F.array().cast("array<string>"))
    return F.slice(F.when(F.size(named) > 0, named).otherwise(raw), 1, 4)


def to_row(qr: Column, barcode: Column, sku: Column) -> Column:
    """The QR fields of an export row; null where nothing is to be set. ``barcode`` and ``sku``: what the row has."""
    raw = F.coalesce(qr["raw"], F.lit(""))
    named = F.coalesce(blank_to_null(qr["sku"]), blank_to_null(qr["id"]), blank_to_null(qr["code"]))
    from_name = F.when(F.length(digits(named)).between(9, 15), digits(named))
    from_raw = blank_to_null(F.regexp_extract(F.replace(raw, F.lit("."), F.lit("")), "([0-9]{9,15})", 1))
    open_ = blank_to_null(sku).isNull()
    values = {
        "raw_qr_data": blank_to_null(raw),
        "qr_code_barcode": F.when(blank_to_null(barcode).isNull(), qr["barcode"]),
        **{f"price{i}_qr": F.try_element_at(prices(qr), F.lit(i)) for i in (1, 2, 3, 4)},
        "id_sku": F.when(open_, F.when(named.isNotNull(), from_name).otherwise(from_raw)),
        **{k: qr[k] for k in PASSED},
    }
    return F.struct(*(v.alias(k) for k, v in values.items()))
