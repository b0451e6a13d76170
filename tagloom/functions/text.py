"""Fields of a tag from its text lines, as column expressions.

``texts`` is an array of strings in line order; null entries are skipped, except that the export
functions read other types through their string form, which the caller casts beforehand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = r"([0-9]{1,5})[.,]([0-9]{1,2})|([0-9]{1,5})"
DISCOUNT = r"-?[0-9]+\s*%"
DATE = r"[0-9]{2}[./][0-9]{2}[./][0-9]{2,4}"
BARCODE = r"(?U)\b([0-9]{12,13})\b"
SKU = r"(?U)\b([0-9]{9,15})\b"
NUMERIC = r"^[0-9.,%/\-]+$"
#: Pattern and symbol, in output order.
OCR_SYMBOLS = (("[%]", "%"), ("[Шш]", "Ш"), ("[★☆]", "★"), ("[№#]", "№"))
EXPORT_SYMBOLS = (("[Шш]", "Ш"), ("[★☆]", "★"), ("[%]", "%"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strings(texts: Column) -> Column:
    return F.filter(texts, lambda t: t.isNotNull())


def first_of(texts: Column, pick: Callable[[Column], Column]) -> Column:
    """The first non-empty ``pick`` of the texts, or null."""
    return F.try_element_at(F.filter(F.transform(strings(texts), pick), lambda x: x.isNotNull() & (x != "")), F.lit(1))


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def is_barcode_like(t: Column) -> Column:
    return F.coalesce(F.length(digits(t)) >= 12, F.lit(False))


def is_date_like(t: Column) -> Column:
    return F.trim(t).rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$")


def is_time_like(t: Column) -> Column:
    return F.trim(t).rlike(r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$")


def is_sku_like(t: Column) -> Column:
    return (F.length(digits(t)) >= 6) & ~t.rlike("[.,]")


def _price(t: Column) -> Column:
    return F.replace(F.regexp_extract(t, PRICE, 0), F.lit(","), F.lit(".")).try_cast("double")


def _descending(prices: Column, high: float) -> Column:
    return F.sort_array(F.array_distinct(F.filter(prices, lambda p: p.isNotNull() & p.between(10, high))), asc=False)


def price_list(texts: Column, engine: str = "export") -> Column:
    """Distinct prices, highest first. ``export`` strips each text and skips long digit runs;
    ``ocr`` skips dates, times and article numbers; ``paddle`` strips only. Nothing found: an empty
    array for export, else null."""
    stripped = lambda t: F.regexp_replace(t, "[^0-9.,]", "")
    if engine == "export":
        use = F.filter(strings(texts), lambda t: ~is_barcode_like(t) & (F.length(stripped(t)) < 12))
        return _descending(F.transform(use, lambda t: _price(stripped(t))), 1_000_000)
    if engine == "ocr":
        use = F.filter(strings(texts), lambda t: ~(is_date_like(t) | is_time_like(t) | is_sku_like(F.trim(t))))
        found = _descending(F.transform(use, lambda t: _price(F.trim(t))), 999_999)
    else:
        found = _descending(F.transform(strings(texts), lambda t: _price(stripped(t))), 1_000_000)
    return F.when(F.size(found) > 0, found)


def ranked_prices(prices: Column) -> list[Column]:
    """Default, card and discount price: the three highest."""
    return [F.try_element_at(prices, F.lit(i)) for i in (1, 2, 3)]


def discount(texts: Column) -> Column:
    return first_of(texts, lambda t: F.regexp_extract(t, DISCOUNT, 0))


def date_text(texts: Column) -> Column:
    return first_of(texts, lambda t: F.regexp_extract(t, DATE, 0))


def valid_ean(code: Column) -> Column:
    """Check digit of 12 or 13 digits, every second one from the left weighing 3."""
    weighted = F.transform(F.sequence(F.lit(1), F.length(code) - 1), lambda i: F.substring(code, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    last = F.substring(code, F.length(code), F.lit(1)).cast("int")
    return F.when(F.coalesce(code.rlike("^[0-9]{12,13}$"), F.lit(False)), (10 - total % 10) % 10 == last).otherwise(False)


def barcode(texts: Column) -> Column:
    """The first text's word-bounded 12 or 13 digits that pass the check."""

    def pick(t: Column) -> Column:
        code = F.regexp_extract(t, BARCODE, 1)
        return F.when(valid_ean(code), code)

    return first_of(texts, pick)


def joined(texts: Column) -> Column:
    return F.array_join(strings(texts), " ")


def ocr_symbols(texts: Column) -> Column:
    """Symbols found in all texts together, in fixed order; null for none."""
    found = F.array(*(F.when(joined(texts).rlike(p), s) for p, s in OCR_SYMBOLS))
    return blank_to_null(F.array_join(found, ","))


def export_symbols(texts: Column, color: Column) -> Column:
    """Colour word and symbols, distinct and sorted; null for none."""
    named = F.array(F.when(color.isin("red", "yellow"), color))
    found = F.flatten(F.transform(strings(texts), lambda t: F.array(*(F.when(t.rlike(p), s) for p, s in EXPORT_SYMBOLS))))
    every = F.array_sort(F.array_distinct(F.array_compact(F.concat(named, found))))
    return blank_to_null(F.array_join(every, ","))


def _named(t: Column, more_than: int, numeric: str) -> Column:
    return (F.length(t) > more_than) & ~t.rlike("[0-9]{6,}") & ~t.rlike(numeric)


def longest_name(texts: Column) -> Column:
    """The longest text of over 10 characters that is no number; the first of equally long ones."""
    use = F.filter(strings(texts), lambda t: _named(t, 10, NUMERIC))
    ranked = F.transform(use, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.array_max(ranked)["t"]


def first_name(texts: Column) -> Column:
    """The first text of over 15 characters that is no number."""
    return F.try_element_at(F.filter(strings(texts), lambda t: _named(t, 15, r"^[0-9]+[.,]?[0-9]*$")), F.lit(1))


def plain_name(texts: Column) -> Column:
    """All texts without digits, joined."""
    return blank_to_null(F.array_join(F.filter(strings(texts), lambda t: ~t.rlike("[0-9]")), " "))


def sku(texts: Column, code: Column) -> Column:
    """A run of 9 to 15 digits, looked for only without a barcode."""
    return F.when(code.isNull(), blank_to_null(F.regexp_extract(joined(texts), SKU, 1)))


def additional(texts: Column, name: Column) -> Column:
    """Up to three short texts that are neither the name nor numbers."""
    use = F.filter(strings(texts), lambda t: F.length(t).between(4, 29) & ~t.eqNullSafe(name) & ~t.rlike(NUMERIC))
    return blank_to_null(F.array_join(F.slice(use, 1, 3), " | "))


def tag_info(texts: Column, engine: str = "ocr") -> Column:
    """All fields of a tag from its lines. ``paddle`` strips prices and takes any 12 or 13 digits as barcode."""
    every = joined(texts)
    code = blank_to_null(F.regexp_extract(every, BARCODE, 1))
    code = code if engine == "paddle" else F.when(valid_ean(code), code)
    prices, name = price_list(texts, engine), longest_name(texts)
    values = dict(zip(("price_default", "price_card", "price_discount"), ranked_prices(prices))) | {
        "discount_amount": blank_to_null(F.regexp_extract(every, DISCOUNT, 0)),
        "barcode": code,
        "print_datetime": blank_to_null(F.regexp_extract(every, DATE, 0)),
        "product_name": name,
        "id_sku": sku(texts, code),
        "special_symbols": ocr_symbols(texts),
        "additional_info": additional(texts, name),
    }
    return F.struct(*(v.alias(k) for k, v in values.items()))


def simple_info(texts: Column) -> Column:
    """Prices, barcode and name only."""
    prices = dict(zip(("price_default", "price_card", "price_discount"), ranked_prices(price_list(texts, "ocr"))))
    values = prices | {"barcode": barcode(texts), "product_name": longest_name(texts)}
    return F.struct(*(v.alias(k) for k, v in values.items()))


def single_fields(texts: Column, decoded: Column | None = None, payload: Column | None = None) -> Column:
    """Highest price, joined name, barcode and QR code; a ``decoded`` barcode that passes the check goes first.
    ``payload``: the decoded QR text, null where it is empty."""
    code = barcode(texts)
    if decoded is not None:
        code = F.coalesce(F.when(valid_ean(digits(decoded)), digits(decoded)), code)
    price = F.try_element_at(price_list(texts, "ocr"), F.lit(1))
    qr_code = F.lit(None).cast("string") if payload is None else blank_to_null(payload)
    return F.struct(price.alias("price"), plain_name(texts).alias("product_name"), code.alias("barcode"), qr_code.alias("qr_code"))
