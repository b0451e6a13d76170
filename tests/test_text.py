import pytest
from pyspark.sql import functions as F

from tagloom.functions import qr, text


@pytest.fixture(scope="module")
def ev(spark):
    def run(column, **values):
        kinds = {"texts": "array<string>", "t": "string"}
        df = spark.range(1).select(*(F.lit(None).cast(kinds[k]).alias(k) if v is None else (F.array(*map(F.lit, v)).cast(kinds[k]) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in values.items()))
        return df.select(column.alias("v")).first()["v"]

    return run


def X():
    return F.col("texts")


@pytest.mark.parametrize("texts, expected", [
    (["150.00", "299.90", "199.50"], [299.9, 199.5, 150.0]), (["99,99"], [99.99]), (["1 299"], [1299.0]), (["123456789012"], []), (["5"], []), (["0"], []),
    (["-5"], []), ([], []), ([None, "123", "99.99"], [123.0, 99.99]), (["99.99", "99.99"], [99.99]), (["1.299,50"], []), (["9999999"], [99999.0]), (["31.12.2025"], [31.12]), (["25%"], [25.0]),
])
def test_export_prices(ev, texts, expected):
    assert ev(text.price_list(X()), texts=texts) == expected


def test_ocr_prices_skip_dates_times_articles(ev):
    assert ev(text.price_list(X(), "ocr"), texts=["31.12.2025", "12:30", "1234567", "1 299"]) is None
    assert ev(text.price_list(X(), "ocr"), texts=["1234567", "49.90"]) == [49.9]
    assert ev(text.price_list(X(), "paddle"), texts=["1 299"]) == [1299.0]


@pytest.mark.parametrize("texts, expected", [
    (["4600644110002"], "4600644110002"), (["code 4600644110002 x"], "4600644110002"), (["4600644110006"], None), (["12345678901"], None), ([None], None),
    (["штрихкод4600644110002"], None), (["036000291452"], None),
])
def test_barcode(ev, texts, expected):
    assert ev(text.barcode(X()), texts=texts) == expected


@pytest.mark.parametrize("texts, expected", [(["скидка 25%"], "25%"), (["-15%"], "-15%"), (["скидка 25"], None), (["5 %", "7%"], "5 %")])
def test_discount(ev, texts, expected):
    assert ev(text.discount(X()), texts=texts) == expected


@pytest.mark.parametrize("texts, expected", [(["01.01.2025"], "01.01.2025"), (["15/06/26"], "15/06/26"), (["действует до 31.12.2025 г."], "31.12.2025"), (["x"], None)])
def test_date(ev, texts, expected):
    assert ev(text.date_text(X()), texts=texts) == expected


def test_symbols(ev):
    assert ev(text.export_symbols(X(), F.lit("red")), texts=["Шт 25%"]) == "%,red,Ш"
    assert ev(text.export_symbols(X(), F.lit("white")), texts=["plain"]) is None
    assert ev(text.ocr_symbols(X()), texts=["№ 5", "★ %"]) == "%,★,№"


def test_names(ev):
    assert ev(text.longest_name(X()), texts=["short", "молоко цельное", "молоко цельно2", "1234567 длинный"]) == "молоко цельное"
    assert ev(text.first_name(X()), texts=["a text longer than that", "another longer text here"]) == "a text longer than that"
    info = ev(text.tag_info(X()), texts=["Молоко пастеризованное", "89,90", "-10%", "01.02.2025", "4600644110002"])
    assert (info.price_default, info.discount_amount, info.barcode, info.print_datetime, info.product_name, info.id_sku) == (89.9, "-10%", "4600644110002", "01.02.2025", "Молоко пастеризованное", None)


@pytest.mark.parametrize("raw, expected", [
    ('{"price": 1.5, "a": {"b": 2}}', {"price": "1.5", "a": '{"b":2}'}), ("price=299.90;sku=123456789;discount=15%", {"price": "299.90", "sku": "123456789", "discount": "15%"}),
    ("price=150.00\nsku=987654321", {"price": "150.00", "sku": "987654321"}), ("field1|field2|field3", {"field_0": "field1", "field_1": "field2", "field_2": "field3"}),
    ("just text", {"raw": "just text"}), ('{"broken json', {"raw": '{"broken json'}), ("", {}), (None, {}), ("a=1;b=2;a=3", {"a": "3", "b": "2"}), ("https://a/b", {"https": "//a/b"}),
])
def test_qr(ev, raw, expected):
    assert ev(qr.parse(F.col("t")), t=raw) == expected


def test_barcode_like(ev):
    for value, expected in (("4600644110006", True), ("abc123456789012", True), ("123", False), (None, False), ("12345678901", False)):
        assert ev(text.is_barcode_like(F.col("t")), t=value) is expected


def test_label_text_of_the_whole_table(spark, sf_dir):
    from tagloom.plans import catalog
    from tagloom.plans import fixtures as fx

    rows = fx.view(spark, sf_dir, fx.LABELS).collect()
    expected = sorted((r.split, r.file, r.line_no, f"0 {r.cx:.6f} {r.cy:.6f} {r.w:.6f} {r.h:.6f}") for r in rows)
    got = sorted(tuple(r) for r in catalog.queries()["label_text"](spark, sf_dir).collect())
    assert got == expected and len(got) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
