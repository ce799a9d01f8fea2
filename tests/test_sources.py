import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import quality
from tallygrid.sources import csv_tables, loading, messages, wide_orders


def write(path, text):
    path.write_text(text)
    return str(path)


def test_products_with_bad_cost(spark, tmp_path):
    path = write(tmp_path / "p.csv", "ProductID,ProductName,Category,Brand,Cost_Price\nP1,,Toys,Acme,10\nP2,Ball,Toys,Acme,free\n")
    rows = csv_tables.ingest_products(spark, path).orderBy("product_id").collect()
    assert rows[0].product_name == "Unknown Product" and rows[0].unit_price == 13.0
    assert (rows[1].cost_price, rows[1].unit_price) == (0.0, 0.0)


def test_customers_defaults(spark, tmp_path):
    path = write(tmp_path / "c.csv", "CustomerID,CustomerName,Customer_Type,City,State,Country\nC1,,,X,Y,\n")
    row = csv_tables.ingest_customers(spark, path).first()
    assert (row.customer_name, row.customer_type, row.country) == ("Unknown Customer", "New", "USA")


def test_inventory_is_clipped(spark, tmp_path):
    path = write(tmp_path / "i.csv", "ProductID,Initial_Stock,Current_Stock,Reorder_Level,Restock_Quantity,Stock_Status\nP1,10,-4,x,7.9,\n")
    row = csv_tables.ingest_inventory(spark, path).first()
    assert (row.initial_stock, row.current_stock, row.reorder_level, row.restock_quantity, row.stock_status) == (10, 0, 0, 7, "Unknown")


def test_bad_dates_become_null(spark, tmp_path):
    path = write(tmp_path / "o.csv", "OrderID,OrderDate,CustomerID,PaymentMethod,OrderStatus,Delivery_Date\nO1,2024-02-30,C,Card,Delivered,2024-03-01\nO2,2024-01-05 10:30:00,C,Card,Delivered,soon\n")
    rows = csv_tables.ingest_orders(spark, path).orderBy("order_id").collect()
    assert rows[0].order_date is None and rows[0].delivery_date == dt.datetime(2024, 3, 1)
    assert rows[1].order_date == dt.datetime(2024, 1, 5, 10, 30) and rows[1].delivery_date is None


def test_items_returned_words_and_quantity(spark, tmp_path):
    words = ["true", "1", "Yes", "No", ""]
    body = "".join(f"O{i},P,S,{q},9.5,0,0,0,x,1,2,{w},0\n" for i, (w, q) in enumerate(zip(words, ["3", "0", "-2", "many", "2"])))
    path = write(tmp_path / "t.csv", "OrderID,ProductID,SellerID,Quantity,UnitPrice,Discount,Tax,ShippingCost,TotalAmount,Profit,Profit_Margin,Returned,Refund_Amount\n" + body)
    rows = csv_tables.ingest_order_items(spark, path).orderBy("order_id").collect()
    assert [r.returned for r in rows] == [True, True, True, False, False]
    assert [r.quantity for r in rows] == [3, 1, 1, 1, 2] and rows[0].total_amount == 0.0


def test_seller_names(spark, tmp_path):
    path = write(tmp_path / "s.csv", "SellerID,SellerRating\nSEL-42,5\n77,4\n")
    rows = csv_tables.ingest_sellers(spark, path).orderBy("seller_id").collect()
    assert [r.seller_name for r in rows] == ["Seller 77", "Seller 42"]
    named = write(tmp_path / "n.csv", "SellerID,SellerName\nSEL-1,Ann\n")
    assert csv_tables.ingest_sellers(spark, named).first().seller_name == "Ann"


def test_wide_file_needs_its_columns(spark):
    with pytest.raises(ValueError, match="Missing required columns"):
        wide_orders.split_wide(spark.range(1))


def test_first_row_per_key_by_order(spark):
    frame = spark.createDataFrame([("P", 2, "late"), ("P", 1, "early"), ("Q", 5, "only")], "k string, o int, v string")
    assert {r.k: r.v for r in wide_orders.first_per_key(frame, "k", ["v"], ["o", "v"]).collect()} == {"P": "early", "Q": "only"}


def test_upload_aliases(spark):
    frame = spark.createDataFrame([("2024-01-01", "5", "A", None), ("2024-01-02", "3", "B", "Cancelled"), ("2024-01-03", "2", "B", "Delivered")],
                                  "Date string, Units string, Product_Category string, OrderStatus string")
    report = wide_orders.upload_report(wide_orders.prepare_upload(frame)).first()
    assert (report.records_processed, report.categories, report.first_date) == (2, ["A", "B"], dt.date(2024, 1, 1))
    assert wide_orders.missing_upload_columns(["date", "units"]) == ["category"]
    with pytest.raises(ValueError):
        wide_orders.prepare_upload(spark.range(1))


@pytest.mark.parametrize("entity, rows, schema, valid, invalid", [
    ("customers", [("C001", "John"), ("C002", "Jane"), ("C003", None)], "customer_id string, customer_name string", True, 1),
    ("products", [("P1", "Widget", 10.0), ("P2", "Gadget", 20.0), ("P3", "Thing", -5.0)], "product_id string, product_name string, cost_price double", False, 1),
    ("inventory", [("P1", 100, 10), ("P2", -10, 5)], "product_id string, current_stock int, reorder_level int", False, 1),
    ("orders", [("O1", dt.datetime(2024, 1, 1)), ("O2", dt.datetime(2024, 1, 2))], "order_id string, order_date timestamp", True, 0),
    ("order_items", [("O1", "P", 1, 10.0), ("O2", "P", 0, 20.0), ("O3", "P", 5, 30.0)], "order_id string, product_id string, quantity int, unit_price double", False, 1)])
def test_validation_outcomes(spark, entity, rows, schema, valid, invalid):
    row = quality.validate(spark.createDataFrame(rows, schema), entity).first()
    assert (row.is_valid, row.invalid_records, row.total_records) == (valid, invalid, len(rows))


def test_row_breaking_two_rules_counts_twice(spark):
    row = quality.validate(spark.createDataFrame([("P1", None, -1.0), ("P1", "x", 1.0)], "product_id string, product_name string, cost_price double"), "products").first()
    assert (row.invalid_records, row.distinct_invalid_rows, row.valid_records) == (2, 1, 0)
    assert row.warnings == ["Found 1 duplicate product IDs"] and len(row.errors) == 2


def test_unknown_entity_and_missing_columns(spark):
    with pytest.raises(ValueError, match="Unknown entity"):
        quality.validate(spark.range(1), "planets")
    row = quality.validate(spark.range(3), "orders").first()
    assert (row.is_valid, row.invalid_records, row.error_rate) == (False, 3, 1.0)


def test_error_rate(spark):
    rates = spark.createDataFrame([(100, 20), (0, 0)], "t int, i int").select(quality.error_rate(F.col("t"), F.col("i")).alias("r")).collect()
    assert [r.r for r in rates] == [0.2, 0.0]


def test_orphans(spark):
    child = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    parent = spark.createDataFrame([("b",)], "k string")
    assert quality.fk_orphans({"r": (child, "k", parent, "k")}).first().orphans == 1


def test_zero_deviation_scale(spark):
    frame = spark.createDataFrame([(5.0,)] * 9 + [(50.0,)], "x double")
    assert quality.mad_outliers(frame, "x").first().outliers == 1
    assert quality.zscore_outliers(spark.createDataFrame([(5.0,)] * 4, "x double"), "x").first().outliers == 0


def test_sales_files_prune_by_month(spark, sales_of, tmp_path):
    path = str(tmp_path / "sales")
    loading.write_sales(sales_of([("P", "c", "2024-01-05", 1, 1), ("P", "c", "2024-02-05", 2, 1)]), path)
    back = spark.read.parquet(path)
    assert back.where("order_month = '2024-02'").first().quantity == 2 and back.count() == 2


def test_exports_by_category(spark, tmp_path):
    path = str(tmp_path / "out")
    loading.write_exports(spark.createDataFrame([("A", 1), ("B", 2)], "category string, v int"), path, "category")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"category=A", "category=B"}


def test_broker_options():
    source = messages.source_options("host:9092", max_per_batch=500)
    assert source["subscribe"] == "inventory.alerts,inventory.forecasts,inventory.orders,inventory.stock"
    assert source["startingOffsets"] == "latest" and source["maxOffsetsPerTrigger"] == "500"
    sink = messages.sink_options("host:9092")
    assert (sink["kafka.acks"], sink["kafka.retries"]) == ("all", "3")


def test_malformed_csv_lines_are_kept(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_text("SellerID,SellerName,SellerRating,Location\ns1,A,4.5,X\ns2,B,4.0,Y,surplus\ns3,C\n")
    raw = csv_tables.read_raw(spark, str(path)).cache()
    assert sorted(r[csv_tables.CORRUPT] for r in csv_tables.malformed_lines(raw).collect()) == ["s2,B,4.0,Y,surplus", "s3,C"]
    assert csv_tables.sellers_from_raw(raw).count() == 3


def test_lost_offsets_stop_the_source():
    assert messages.source_options("host:9092")["failOnDataLoss"] == "true"
    assert messages.source_options("host:9092", fail_on_data_loss=False)["failOnDataLoss"] == "false"
