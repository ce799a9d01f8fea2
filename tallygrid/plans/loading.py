"""Named ingestion and loading queries over raw text derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.columns import money, rnd, safe_cast
from ..operators.ordered import dealt
from ..session import ensure_checkpoint_dir
from ..sources import csv_tables as raw, keyed, loading as ops, wide_orders as wide
from .registry import query, rounded as R


def _raw_customers(t):
    k = F.col("customer_id")
    return t.customers.select(
        k.cast("string").alias("CustomerID"), F.when(k % 50 != 0, F.col("customer_name")).alias("CustomerName"),
        F.when(k % 41 != 0, F.col("customer_type")).alias("Customer_Type"), F.col("city").alias("City"),
        F.col("state").alias("State"), F.when(k % 7 != 0, F.col("country")).alias("Country"))


query("ingest_customers", """
  SELECT customer_id::VARCHAR AS customer_id, CASE WHEN customer_id % 50 <> 0 THEN customer_name ELSE 'Unknown Customer' END AS customer_name,
         CASE WHEN customer_id % 41 <> 0 THEN customer_type ELSE 'New' END AS customer_type, city, state,
         CASE WHEN customer_id % 7 <> 0 THEN country ELSE 'USA' END AS country FROM customers""")(
    lambda t: raw.customers_from_raw(_raw_customers(t)))


def _raw_products(t):
    k = F.col("product_id")
    return t.catalog.select(
        k.cast("string").alias("ProductID"), F.when(k % 50 != 0, F.col("product_name")).alias("ProductName"),
        F.col("category").alias("Category"), F.col("brand").alias("Brand"),
        F.when(k % 13 == 0, "n/a").otherwise(F.col("cost_price").cast("string")).alias("Cost_Price"))


query("ingest_products", f"""
  SELECT product_id::VARCHAR AS product_id, CASE WHEN product_id % 50 <> 0 THEN product_name ELSE 'Unknown Product' END AS product_name,
         category, brand, CASE WHEN product_id % 13 = 0 THEN 0 ELSE {R('cost_price', 4)} END AS cost_price,
         CASE WHEN product_id % 13 = 0 THEN 0 ELSE {R('cost_price * 1.3::DOUBLE', 4)} END AS unit_price FROM catalog""")(
    lambda t: raw.products_from_raw(_raw_products(t)).withColumns(
        {c: rnd(c, 4) for c in ("cost_price", "unit_price")}))


def _raw_inventory(t):
    k = F.col("product_id")
    return t.products.select(
        k.cast("string").alias("ProductID"), F.when(k % 11 == 0, "x").otherwise(F.col("initial_stock").cast("string")).alias("Initial_Stock"),
        (F.col("current_stock") - F.when(k % 6 == 0, 500).otherwise(0)).cast("string").alias("Current_Stock"),
        F.col("reorder_threshold").cast("string").alias("Reorder_Level"),
        F.when(k % 5 != 0, F.concat(F.col("reorder_quantity").cast("string"), F.lit(".7"))).alias("Restock_Quantity"),
        F.when(k % 4 != 0, F.col("stock_status")).alias("Stock_Status"))


_INVENTORY = """
  SELECT product_id::VARCHAR AS product_id, CASE WHEN product_id % 11 = 0 THEN 0 ELSE initial_stock END AS initial_stock,
         greatest(current_stock - CASE WHEN product_id % 6 = 0 THEN 500 ELSE 0 END, 0) AS current_stock,
         reorder_threshold AS reorder_level, CASE WHEN product_id % 5 <> 0 THEN reorder_quantity ELSE 0 END AS restock_quantity,
         CASE WHEN product_id % 4 <> 0 THEN stock_status ELSE 'Unknown' END AS stock_status FROM products"""
query("ingest_inventory", _INVENTORY)(lambda t: raw.inventory_from_raw(_raw_inventory(t)))


def _raw_orders(t):
    k, day = F.col("order_id"), F.date_format("order_date", "yyyy-MM-dd")
    return t.orders.select(
        k.cast("string").alias("OrderID"), F.when(k % 9 == 0, "not a date").otherwise(day).alias("OrderDate"),
        F.col("customer_id").cast("string").alias("CustomerID"), F.col("payment_method").alias("PaymentMethod"),
        F.col("order_status").alias("OrderStatus"), F.when(k % 4 != 0, day).alias("Delivery_Date"))


query("ingest_orders", """
  SELECT order_id::VARCHAR AS order_id, CASE WHEN order_id % 9 <> 0 THEN CAST(order_date AS DATE) END AS order_date,
         customer_id::VARCHAR AS customer_id, payment_method, order_status,
         CASE WHEN order_id % 4 <> 0 THEN CAST(order_date AS DATE) END AS delivery_date FROM orders_c""")(
    lambda t: raw.orders_from_raw(_raw_orders(t)).withColumns(
        {c: F.to_date(c) for c in ("order_date", "delivery_date")}))


def _raw_items(t):
    k = F.col("order_id")
    text = {"UnitPrice": "unit_price", "Discount": "discount", "Tax": "tax", "ShippingCost": "shipping_cost",
            "TotalAmount": "total_amount", "Profit": "profit", "Profit_Margin": "profit_margin",
            "Refund_Amount": "refund_amount"}
    words = F.when(F.col("returned"), F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "1").otherwise("TRUE")).when(
        k % 2 == 0, "No")
    return t.order_items.select(
        k.cast("string").alias("OrderID"), F.col("product_id").cast("string").alias("ProductID"),
        F.col("seller_id").cast("string").alias("SellerID"),
        F.when(k % 8 == 0, "-3").when(k % 8 == 1, "many").otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        *[F.when(k % 15 == 0, "?").otherwise(F.col(c).cast("string")).alias(n) for n, c in text.items()],
        words.alias("Returned"))


query("ingest_order_items", f"""
  SELECT product_id::VARCHAR AS product_id, count(*) AS rows,
         CAST(sum(CASE WHEN order_id % 8 IN (0, 1) THEN 1 ELSE greatest(quantity, 1) END) AS BIGINT) AS units,
         {R('sum(CASE WHEN order_id % 15 = 0 THEN 0 ELSE total_amount END)')} AS revenue,
         {R('sum(CASE WHEN order_id % 15 = 0 THEN 0 ELSE profit END)')} AS profit, count(*) FILTER (returned) AS returns
  FROM items GROUP BY 1""")(
    lambda t: raw.order_items_from_raw(_raw_items(t)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"), money(F.sum("total_amount")).alias("revenue"),
        money(F.sum("profit")).alias("profit"), F.count(F.when(F.col("returned"), 1)).alias("returns")))
query("ingest_sellers", """
  SELECT 'SEL-' || seller_id AS seller_id, 'Seller ' || seller_id AS seller_name FROM sellers""")(
    lambda t: raw.sellers_from_raw(t.sellers.select(
        F.concat(F.lit("SEL-"), F.col("seller_id").cast("string")).alias("SellerID"))))
query("null_safe_cast", """
  SELECT order_id, CASE WHEN order_id % 7 = 0 THEN -1 ELSE CAST(order_id % 100 AS INTEGER) END AS number FROM orders_c""")(
    lambda t: t.orders.select("order_id", safe_cast(
        F.when(F.col("order_id") % 7 == 0, "bad").otherwise((F.col("order_id") % 100).cast("string")), "int", -1).alias("number")))


def _wide(t, last="product"):
    """The wide order table. Customers join the orders; the side that is reported joins the lines last, so its texts do
    not travel with them, and its grouping needs no further exchange of lines."""
    buyers = t.orders.join(t.customers.select("customer_id", "customer_name", "city", "state", "country"), "customer_id")
    attributes = t.catalog.select("product_id", "product_name", "category", "brand")
    sides = [("order_id", buyers), ("product_id", attributes)]
    flat = t.order_items
    for key, side in sides if last == "product" else sides[::-1]:
        flat = dealt(flat, t.tasks, key).join(side, key)
    names = {"OrderID": "order_id", "OrderDate": "order_date", "CustomerID": "customer_id", "CustomerName": "customer_name",
             "ProductID": "product_id", "ProductName": "product_name", "Category": "category", "Brand": "brand",
             "Quantity": "quantity", "UnitPrice": "unit_price", "Discount": "discount", "Tax": "tax",
             "ShippingCost": "shipping_cost", "TotalAmount": "total_amount", "PaymentMethod": "payment_method",
             "OrderStatus": "order_status", "City": "city", "State": "state", "Country": "country", "SellerID": "seller_id"}
    return flat.select(*[F.col(c).alias(n) for n, c in names.items()])


query("load_denormalised_products", f"""
  SELECT product_id, any_value(product_name) AS product_name, any_value(category) AS category, any_value(brand) AS brand,
         {R('arg_min(sales.unit_price, ROW(order_date, order_id, sales.unit_price, total_amount))', 4)} AS unit_price, 0 AS current_stock
  FROM sales JOIN catalog USING (product_id) GROUP BY product_id""")(
    lambda t: wide.split_wide(_wide(t))["products"].withColumn("unit_price", rnd("unit_price", 4)))
query("load_denormalised_customers", """
  SELECT DISTINCT customer_id, customer_name, city, state, country FROM sales JOIN customers USING (customer_id)""")(
    lambda t: wide.split_wide(_wide(t, "order"))["customers"])
query("load_denormalised_orders", f"""
  SELECT order_status, count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS units, {R('sum(total_amount)')} AS revenue
  FROM sales GROUP BY 1""")(
    lambda t: wide.split_wide(_wide(t, "order"))["orders"].groupBy("order_status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"), money(F.sum("total_amount")).alias("revenue")))
query("upload_alias_map", """
  SELECT count(*) AS records_processed, CAST(min(order_date) AS DATE) AS first_date, CAST(max(order_date) AS DATE) AS last_date,
         array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
  FROM sales JOIN catalog USING (product_id) WHERE order_status <> 'Cancelled'""")(
    lambda t: wide.upload_report(wide.prepare_upload(t.sales.join(t.catalog.select("product_id", "category"), "product_id").select(
        F.col("order_date").alias("Date"), F.col("quantity").alias("QTY"), F.col("category").alias("Cat"),
        F.col("order_status").alias("OrderStatus")))).withColumn("categories", F.concat_ws(",", "categories")))
query("seed_stock_levels", """
  s AS (SELECT product_id, CAST(greatest(floor(coalesce(sum(quantity), 0) * 0.3::DOUBLE), 50) AS INTEGER) AS initial_stock
        FROM catalog LEFT JOIN (SELECT product_id, quantity FROM sales) USING (product_id) GROUP BY 1),
  c AS (SELECT *, CAST(greatest(floor(initial_stock * 0.4::DOUBLE), 20) AS INTEGER) AS current_stock FROM s)
  SELECT *, CAST(greatest(floor(initial_stock * 0.2::DOUBLE), 10) AS INTEGER) AS reorder_threshold,
         CAST(greatest(floor(initial_stock * 0.5::DOUBLE), 25) AS INTEGER) AS reorder_quantity,
         CASE WHEN current_stock > 10 THEN 'In Stock' ELSE 'Low Stock' END AS stock_status FROM c""")(
    lambda t: ops.seed_stock_levels(t.catalog, t.sales))
query("seed_line_profit", f"""
  p AS (SELECT product_id, total_amount, total_amount - unit_price * 0.6::DOUBLE * quantity - shipping_cost AS profit FROM sales)
  SELECT product_id, {R('sum(profit)')} AS profit,
         {R('avg(CASE WHEN total_amount > 0 THEN profit / total_amount * 100 ELSE 0 END)', 4)} AS avg_margin FROM p GROUP BY 1""")(
    lambda t: ops.seed_line_profit(t.sales).groupBy("product_id").agg(
        money(F.sum("profit")).alias("profit"), rnd(F.avg("profit_margin"), 4).alias("avg_margin")))


def _versions(t):
    stored = t.catalog.select("product_id", "product_name", "unit_price", F.lit(1).alias("load_no"))
    fresh = stored.where("product_id % 3 = 0").select(
        (F.col("product_id") + F.when(F.col("product_id") % 2 == 0, 100000).otherwise(0)).alias("product_id"),
        F.upper("product_name").alias("product_name"), (F.col("unit_price") * 2).alias("unit_price"), F.lit(2).alias("load_no"))
    return stored, fresh


def _merged(t):
    """The stored table as folders by key, merged in place."""
    stored, fresh = _versions(t)
    place = f"{ensure_checkpoint_dir(t.spark)}/dimensions/{uuid.uuid4()}"
    keyed.write_keyed(stored, place, "product_id", 16)
    keyed.upsert_keyed(fresh, place, "product_id", "load_no")
    return keyed.read_keyed(t.spark, place)


query("upsert_dimensions", f"""
  n AS (SELECT product_id + CASE WHEN product_id % 2 = 0 THEN 100000 ELSE 0 END AS product_id, upper(product_name) AS product_name,
               unit_price * 2 AS unit_price, 2 AS load_no FROM catalog WHERE product_id % 3 = 0)
  SELECT product_id, product_name, {R('unit_price')} AS unit_price, load_no FROM n
  UNION ALL SELECT product_id, product_name, {R('unit_price')}, 1 FROM catalog WHERE product_id NOT IN (SELECT product_id FROM n)""")(
    lambda t: _merged(t).withColumn("unit_price", money("unit_price")))
query("attach_inventory", """
  SELECT product_id, CASE WHEN product_id % 3 = 0 THEN initial_stock ELSE initial_stock + 1 END AS initial_stock,
         CASE WHEN product_id % 3 = 0 THEN current_stock WHEN product_id % 4 = 0 THEN 0 ELSE current_stock + 2 END AS current_stock,
         CASE WHEN product_id % 3 = 0 THEN reorder_threshold WHEN product_id % 5 = 0 THEN 10 ELSE reorder_threshold END AS reorder_threshold,
         CASE WHEN product_id % 3 = 0 THEN reorder_quantity ELSE 50 END AS reorder_quantity FROM products""")(
    lambda t: ops.attach_inventory(
        t.products.select("product_id", "initial_stock", "current_stock", "reorder_threshold", "reorder_quantity"),
        t.products.where("product_id % 3 <> 0").select(
            "product_id", (F.col("initial_stock") + 1).alias("initial_stock"),
            F.when(F.col("product_id") % 4 != 0, F.col("current_stock") + 2).alias("current_stock"),
            F.when(F.col("product_id") % 5 != 0, F.col("reorder_threshold")).alias("reorder_level"),
            F.lit(None).cast("int").alias("restock_quantity"))))
query("backfill_unit_price", f"""
  f AS (SELECT product_id, arg_min(unit_price, ROW(order_id, line_no, unit_price)) AS price FROM items GROUP BY 1)
  SELECT product_id, {R('CASE WHEN product_id % 2 = 0 THEN coalesce(price, 0) ELSE unit_price END', 4)} AS unit_price
  FROM catalog LEFT JOIN f USING (product_id)""")(
    lambda t: ops.backfill_unit_price(t.catalog.select(
        "product_id", F.when(F.col("product_id") % 2 == 0, 0.0).otherwise(F.col("unit_price")).alias("unit_price")),
        t.order_items, ["order_id", "line_no", "unit_price"]).withColumn("unit_price", rnd("unit_price", 4)))
query("opening_stock_buffer", """
  SELECT product_id, CAST(coalesce(sum(quantity), 0) + 100 AS BIGINT) AS initial_stock, CAST(100 AS BIGINT) AS current_stock
  FROM catalog LEFT JOIN (SELECT product_id, quantity FROM sales) USING (product_id) GROUP BY 1""")(
    lambda t: ops.opening_stock_buffer(t.catalog, t.sales))
query("load_summary", """
  c AS (SELECT 'sellers' AS table_name, count(*) AS rows FROM sellers UNION ALL SELECT 'customers', count(*) FROM customers
        UNION ALL SELECT 'products', count(*) FROM catalog UNION ALL SELECT 'orders', count(*) FROM orders_c)
  SELECT *, (SELECT count(*) FROM products WHERE current_stock <= reorder_threshold) AS low_stock,
         (SELECT count(*) FROM products WHERE current_stock = 0) AS out_of_stock FROM c""")(
    lambda t: ops.load_summary({"sellers": t.sellers, "customers": t.customers, "products": t.catalog, "orders": t.orders},
                               t.products))
