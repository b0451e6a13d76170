from tagloom.operators import export
from tagloom.schema import EXPORT_COLUMNS


def test_whole_rows_of_new_tags(spark):
    schema = "tracker_id long, filename string, frame_id long, x1 double, y1 double, x2 double, y2 double, texts array<string>, mean_color struct<b:double,g:double,r:double>, qr string"
    red = (50.0, 80.0, 220.0)
    tags = spark.createDataFrame([
        (7, "v.mp4", 12, 1.9, 2.0, 50.5, 60.0, ["Молоко пастеризованное", "89,90", "-10%", "4600644110002"], red, "price=80.50;sku=123456789"),
        (8, "v.mp4", 12, 9.0, 2.0, 5.0, 60.0, ["1"], red, None),
        (9, "v.mp4", 13, 0.0, 0.0, 5.0, 6.0, ["4600644110002"], red, "0077"),
    ], schema)
    catalog = spark.createDataFrame([(1, "Хлеб", "4600644110002")], "row_no long, fullname string, code string")
    rows = {r.tracker_id: r.asDict() for r in export.new_tag_rows(tags, catalog).collect()}
    assert all(set(r) == set(EXPORT_COLUMNS) for r in rows.values())
    a = {k: v for k, v in rows["7"].items() if v}
    assert a == {
        "tracker_id": "7", "filename": "v.mp4", "frame_timestamp": "12", "x_min": "1", "y_min": "2", "x_max": "50", "y_max": "60", "color": "red",
        "price_default": "89.90", "price_card": "10.00", "discount_amount": "-10%", "barcode": "4600644110002", "product_name": "Молоко пастеризованное",
        "special_symbols": "%,red", "price1_qr": "80.50", "id_sku": "123456789",
    }
    assert [rows["8"][c] for c in ("x_min", "y_min", "x_max", "y_max", "product_name")] == [""] * 5
    assert rows["9"]["product_name"] == "Хлеб" and rows["9"]["raw_qr_data"] == "0077"
