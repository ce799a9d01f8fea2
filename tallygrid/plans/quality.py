"""Named validation, profiling and outlier queries.

The driver tables are clean, so the validation queries read them through a view
that breaks known rows by rule; the oracle applies the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import delivered, not_cancelled
from ..operators import quality as ops
from .registry import query, rounded as R


def _customers(t):
    k = F.col("customer_id")
    return t.customers.select((k - F.when(k % 97 == 1, 1).otherwise(0)).alias("customer_id"),
                              F.when(k % 50 != 0, F.col("customer_name")).alias("customer_name"),
                              F.when(k % 41 != 0, F.col("customer_type")).alias("customer_type"), "country")


def _products(t):
    k = F.col("product_id")
    return t.catalog.select((k - F.when(k % 97 == 1, 1).otherwise(0)).alias("product_id"),
                            F.when(k % 50 != 0, F.col("product_name")).alias("product_name"),
                            F.when(k % 31 != 0, F.col("category")).alias("category"),
                            F.when(k % 43 != 0, F.col("brand")).alias("brand"),
                            F.when(k % 71 == 0, -F.col("cost_price")).otherwise(F.col("cost_price")).alias("cost_price"))


def _inventory(t):
    k = F.col("product_id")
    return t.products.select("product_id", (F.col("current_stock") - F.when(k % 60 == 0, 500).otherwise(0)).alias("current_stock"),
                             (F.col("reorder_threshold") - F.when(k % 80 == 0, 5000).otherwise(0)).alias("reorder_level"))


def _orders(t):
    k = F.col("order_id")
    return t.orders.select((k - F.when(k % 97 == 1, 1).otherwise(0)).alias("order_id"),
                           F.when(k % 123 != 0, F.col("order_date")).alias("order_date"))


def _items(t):
    k = F.col("order_id")
    return t.order_items.select(
        "order_id", "product_id", F.when(k % 90 == 0, 0).otherwise(F.col("quantity")).alias("quantity"),
        F.when(k % 110 == 0, -F.col("unit_price")).otherwise(F.col("unit_price")).alias("unit_price"),
        F.when(k % 130 == 0, -F.col("total_amount")).otherwise(F.col("total_amount")).alias("total_amount"),
        F.when(k % 17 != 0, F.col("discount")).alias("discount"), F.when(k % 19 != 0, F.col("tax")).alias("tax"),
        "shipping_cost", "profit")


def _sellers(t):
    k = F.col("seller_id")
    return t.sellers.select((k - F.when(k % 9 == 1, 1).otherwise(0)).alias("seller_id"))


_SOILED = """
  s_customers AS (SELECT customer_id - CASE WHEN customer_id % 97 = 1 THEN 1 ELSE 0 END AS customer_id,
                         CASE WHEN customer_id % 50 <> 0 THEN customer_name END AS customer_name,
                         CASE WHEN customer_id % 41 <> 0 THEN customer_type END AS customer_type, country FROM customers),
  s_products AS (SELECT product_id - CASE WHEN product_id % 97 = 1 THEN 1 ELSE 0 END AS product_id,
                        CASE WHEN product_id % 50 <> 0 THEN product_name END AS product_name,
                        CASE WHEN product_id % 31 <> 0 THEN category END AS category,
                        CASE WHEN product_id % 43 <> 0 THEN brand END AS brand,
                        CASE WHEN product_id % 71 = 0 THEN -cost_price ELSE cost_price END AS cost_price FROM catalog),
  s_inventory AS (SELECT product_id, current_stock - CASE WHEN product_id % 60 = 0 THEN 500 ELSE 0 END AS current_stock,
                         reorder_threshold - CASE WHEN product_id % 80 = 0 THEN 5000 ELSE 0 END AS reorder_level FROM products),
  s_orders AS (SELECT order_id - CASE WHEN order_id % 97 = 1 THEN 1 ELSE 0 END AS order_id,
                      CASE WHEN order_id % 123 <> 0 THEN order_date END AS order_date FROM orders_c),
  s_items AS (SELECT order_id, product_id, CASE WHEN order_id % 90 = 0 THEN 0 ELSE quantity END AS quantity,
                     CASE WHEN order_id % 110 = 0 THEN -unit_price ELSE unit_price END AS unit_price,
                     CASE WHEN order_id % 130 = 0 THEN -total_amount ELSE total_amount END AS total_amount,
                     CASE WHEN order_id % 17 <> 0 THEN discount END AS discount,
                     CASE WHEN order_id % 19 <> 0 THEN tax END AS tax, shipping_cost, profit FROM items),
  s_sellers AS (SELECT seller_id - CASE WHEN seller_id % 9 = 1 THEN 1 ELSE 0 END AS seller_id FROM sellers)"""


def _validated(frame, entity, as_of=None):
    """Result row with its messages as text."""
    return ops.validate(frame, entity, as_of).withColumns({c: F.concat_ws("; ", c) for c in ("errors", "warnings")})


def _validation(entity: str, table: str, key: str | None, label: str,
                checks: list[tuple[str, str, bool, bool]]) -> str:
    counts = "".join(f", count(*) FILTER ({cond}) AS c{i}" for i, (cond, _, _, _) in enumerate(checks))
    repeated = f", count(*) - count(DISTINCT {key}) AS dup" if key else ""
    invalid = " + ".join([f"c{i}" for i, c in enumerate(checks) if c[3]] or ["0"])
    any_broken = " OR ".join([f"coalesce({c[0]}, false)" for c in checks if c[3]] or ["false"])

    def notes(error: bool) -> str:
        parts = [f"CASE WHEN dup > 0 THEN 'Found ' || dup || ' duplicate {label}' END"] if key and not error else []
        parts += [f"CASE WHEN c{i} > 0 THEN 'Found ' || c{i} || ' {m}' END" for i, (_, m, e, _) in enumerate(checks) if e == error]
        return f"list_filter([{', '.join(parts)}]::VARCHAR[], lambda x: x IS NOT NULL)"

    return _SOILED + f""",
      v AS (SELECT count(*) AS total_records, count(*) FILTER ({any_broken}) AS distinct_invalid_rows{counts}{repeated} FROM {table})
      SELECT '{entity}' AS entity, len({notes(True)}) = 0 AS is_valid, total_records,
             CAST(total_records - ({invalid}) AS BIGINT) AS valid_records, CAST({invalid} AS BIGINT) AS invalid_records,
             distinct_invalid_rows, {R(f'({invalid}) / total_records', 4)} AS error_rate,
             array_to_string({notes(True)}, '; ') AS errors, array_to_string({notes(False)}, '; ') AS warnings FROM v"""


query("validate_customers", _validation("customers", "s_customers", "customer_id", "customer IDs", [
    ("customer_name IS NULL", "customers with missing names", False, True)]))(
    lambda t: _validated(_customers(t), "customers"))
query("validate_products", _validation("products", "s_products", "product_id", "product IDs", [
    ("product_name IS NULL", "products with missing names (NOT NULL constraint)", True, True),
    ("cost_price < 0", "products with negative cost prices", True, True)]))(
    lambda t: _validated(_products(t), "products"))
query("validate_inventory", _validation("inventory", "s_inventory", None, "", [
    ("current_stock < 0", "items with negative stock levels", True, True),
    ("reorder_level < 0", "items with negative reorder points", True, True)]))(
    lambda t: _validated(_inventory(t), "inventory"))
query("validate_orders", _validation("orders", "s_orders", "order_id", "order IDs", [
    ("order_date IS NULL", "orders with invalid dates", True, True),
    ("order_date > TIMESTAMP '2000-01-01'", "orders with future dates", False, False)]))(
    lambda t: _validated(_orders(t), "orders", "2000-01-01"))
query("validate_order_items", _validation("order_items", "s_items", None, "", [
    ("quantity <= 0", "items with quantity <= 0", True, True),
    ("unit_price < 0", "items with negative unit prices", True, True),
    ("total_amount < 0", "items with negative total amounts (may be refunds)", False, False)]))(
    lambda t: _validated(_items(t), "order_items"))
query("validate_sellers", _validation("sellers", "s_sellers", "seller_id", "seller IDs", []))(
    lambda t: _validated(_sellers(t), "sellers"))

_PROFILED = ["product_id", "product_name", "category", "brand", "cost_price"]
query("null_profile", _SOILED + " SELECT * FROM (" + " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls,
         {R(f'count(*) FILTER ({c} IS NULL) / count(*) * 100')} AS null_pct FROM s_products""" for c in _PROFILED)
      + ") WHERE nulls > 0")(lambda t: ops.null_profile(_products(t)))
query("duplicate_rows", f"""
  g AS (SELECT l_partkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
         {R('sum(n - 1) / sum(n) * 100')} AS duplicate_pct FROM g""")(
    lambda t: ops.duplicate_rows(t.order_items.select("product_id", "quantity")))
query("duplicate_rows_whole", f"""
  g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_shipdate)
  SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
         {R('sum(n - 1) / sum(n) * 100')} AS duplicate_pct FROM g""")(
    lambda t: ops.duplicate_rows(t.order_items))
query("duplicate_keys", _SOILED + " UNION ALL ".join(
    f" SELECT '{n}' AS table_name, count(*) - count(DISTINCT {k}) AS duplicates FROM s_{n}"
    for n, k in (("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id"), ("sellers", "seller_id"))))(
    lambda t: ops.duplicate_keys({
        "customers": (_customers(t), "customer_id"), "products": (_products(t), "product_id"),
        "orders": (_orders(t), "order_id"), "sellers": (_sellers(t), "seller_id")}))
query("fk_orphans", """
  c AS (SELECT * FROM customers WHERE customer_id % 50 <> 0), p AS (SELECT * FROM catalog WHERE product_id % 50 <> 0)
  SELECT 'order_customer' AS relation, count(DISTINCT customer_id) AS orphans FROM orders_c WHERE customer_id NOT IN (SELECT customer_id FROM c)
  UNION ALL SELECT 'item_product', count(DISTINCT product_id) FROM items WHERE product_id NOT IN (SELECT product_id FROM p)
  UNION ALL SELECT 'item_seller', count(DISTINCT seller_id) FROM items WHERE seller_id NOT IN (SELECT seller_id FROM sellers)
  UNION ALL SELECT 'inventory_product', count(DISTINCT product_id) FROM products WHERE product_id NOT IN (SELECT product_id FROM p)""")(
    lambda t: ops.fk_orphans({
        "order_customer": (t.orders, "customer_id", t.customers.where("customer_id % 50 <> 0"), "customer_id"),
        "item_product": (t.order_items, "product_id", t.catalog.where("product_id % 50 <> 0"), "product_id"),
        "item_seller": (t.order_items, "seller_id", t.sellers, "seller_id"),
        "inventory_product": (t.products, "product_id", t.catalog.where("product_id % 50 <> 0"), "product_id")}))


def _lines(t):
    return t.order_items.join(t.catalog.select("product_id", "category"), "product_id").select("category", "total_amount")


_LINES = "x AS (SELECT category, total_amount FROM items JOIN catalog USING (product_id)),"
_IQR = """
  q AS (SELECT {k} quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.75) AS q3 FROM x {g}),
  b AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM q)"""
query("iqr_outliers", _LINES + _IQR.format(k="", g="") + f"""
  SELECT {R('max(lower)', 4)} AS lower, {R('max(upper)', 4)} AS upper, count(*) AS rows,
         count(*) FILTER (total_amount < lower OR total_amount > upper) AS outliers FROM x, b""")(
    lambda t: ops.iqr_outliers(_lines(t), "total_amount"))
query("iqr_outliers_by_category", _LINES + _IQR.format(k="category,", g="GROUP BY 1") + f"""
  SELECT category, {R('max(lower)', 4)} AS lower, {R('max(upper)', 4)} AS upper, count(*) AS rows,
         count(*) FILTER (total_amount < lower OR total_amount > upper) AS outliers
  FROM x JOIN b USING (category) GROUP BY 1""")(lambda t: ops.iqr_outliers(_lines(t), "total_amount", ["category"]))
query("zscore_outliers", _LINES + f"""
  b AS (SELECT category, avg(total_amount) AS m, stddev_pop(total_amount) AS s FROM x GROUP BY 1)
  SELECT category, {R('max(m)', 4)} AS mean, {R('max(s)', 4)} AS std, count(*) AS rows,
         count(*) FILTER (abs(total_amount - m) / s > 2) AS outliers FROM x JOIN b USING (category) GROUP BY 1""")(
    lambda t: ops.zscore_outliers(_lines(t), "total_amount", ["category"], 2.0))
query("mad_outliers", _LINES + f"""
  m AS (SELECT category, quantile_cont(total_amount, 0.5) AS median FROM x GROUP BY 1),
  d AS (SELECT category, quantile_cont(abs(total_amount - median), 0.5) AS mad FROM x JOIN m USING (category) GROUP BY 1)
  SELECT category, {R('max(median)', 4)} AS median, {R('max(mad)', 4)} AS mad, count(*) AS rows,
         count(*) FILTER (abs(0.6745::DOUBLE * (total_amount - median) / CASE WHEN mad <> 0 THEN mad ELSE 1 END) > 1.5) AS outliers
  FROM x JOIN m USING (category) JOIN d USING (category) GROUP BY 1""")(
    lambda t: ops.mad_outliers(_lines(t), "total_amount", ["category"], 1.5))
query("zscore_outliers_stated", _LINES + f"""
  b AS (SELECT category, avg(total_amount) AS m, stddev_pop(total_amount) AS s FROM x GROUP BY 1)
  SELECT category, {R('max(m)', 4)} AS mean, {R('max(s)', 4)} AS std, count(*) AS rows,
         count(*) FILTER (abs(total_amount - m) / s > 3) AS outliers FROM x JOIN b USING (category) GROUP BY 1""")(
    lambda t: ops.zscore_outliers(_lines(t), "total_amount", ["category"]))
query("mad_outliers_stated", _LINES + f"""
  m AS (SELECT category, quantile_cont(total_amount, 0.5) AS median FROM x GROUP BY 1),
  d AS (SELECT category, quantile_cont(abs(total_amount - median), 0.5) AS mad FROM x JOIN m USING (category) GROUP BY 1)
  SELECT category, {R('max(median)', 4)} AS median, {R('max(mad)', 4)} AS mad, count(*) AS rows,
         count(*) FILTER (abs(0.6745::DOUBLE * (total_amount - median) / CASE WHEN mad <> 0 THEN mad ELSE 1 END) > 3.5) AS outliers
  FROM x JOIN m USING (category) JOIN d USING (category) GROUP BY 1""")(
    lambda t: ops.mad_outliers(_lines(t), "total_amount", ["category"]))
query("outlier_treatments", _LINES + f"""
  q AS (SELECT category, quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.5) AS md,
               quantile_cont(total_amount, 0.75) AS q3 FROM x GROUP BY 1),
  y AS (SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM x JOIN q USING (category)),
  z AS (SELECT category, count(*) AS rows, count(*) FILTER (total_amount NOT BETWEEN lo AND hi) AS removed,
               skewness(total_amount) AS s, skewness(least(greatest(total_amount, lo), hi)) AS sc,
               skewness(ln(1 + total_amount)) AS sl, skewness(total_amount) FILTER (total_amount BETWEEN lo AND hi) AS sr,
               avg((total_amount - md) / (q3 - q1)) AS ms FROM y GROUP BY 1)
  SELECT category, rows, removed, {R('s', 4)} AS skew_original, {R('sc', 4)} AS skew_capped, {R('sl', 4)} AS skew_log,
         {R('sr', 4)} AS skew_removed, {R('ms', 4)} AS mean_scaled,
         CASE WHEN abs(s) > 1 THEN 'log transformation' WHEN abs(s) > 0.5 THEN 'cap outliers' ELSE 'acceptable' END AS advice
  FROM z""")(lambda t: ops.outlier_treatments(_lines(t), "total_amount", ["category"]))
query("clean_products", _SOILED + f"""
  SELECT product_id, coalesce(product_name, 'Unknown Product') AS product_name, coalesce(category, 'Uncategorized') AS category,
         coalesce(brand, 'Generic') AS brand, {R('greatest(cost_price, 0)', 4)} AS cost_price FROM s_products""")(
    lambda t: ops.clean_products(_products(t)).withColumn("cost_price", ops.rnd("cost_price", 4)))
query("clean_customers", _SOILED + """
  SELECT customer_id, coalesce(customer_name, 'Unknown Customer') AS customer_name,
         coalesce(customer_type, 'New') AS customer_type, coalesce(country, 'USA') AS country FROM s_customers""")(
    lambda t: ops.clean_customers(_customers(t)))
query("clean_inventory", _SOILED + """
  SELECT product_id, greatest(current_stock, 0) AS current_stock, greatest(reorder_level, 0) AS reorder_level
  FROM s_inventory""")(lambda t: ops.clean_inventory(_inventory(t)))
query("clean_order_items", _SOILED + f"""
  SELECT count(*) AS rows, CAST(sum(greatest(quantity, 1)) AS BIGINT) AS units, {R('sum(coalesce(discount, 0))')} AS discount,
         {R('sum(coalesce(tax, 0))')} AS tax, min(greatest(quantity, 1)) AS least_quantity FROM s_items""")(
    lambda t: ops.clean_order_items(_items(t)).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"), ops.rnd(F.sum("discount"), 2).alias("discount"),
        ops.rnd(F.sum("tax"), 2).alias("tax"), F.min("quantity").alias("least_quantity")))
query("total_amount_check", _SOILED + f"""
  SELECT count(*) AS rows, count(*) FILTER (abs(quantity * unit_price - discount + tax + shipping_cost - total_amount) > 1) AS mismatches,
         {R('max(abs(quantity * unit_price - discount + tax + shipping_cost - total_amount))', 4)} AS largest_gap
  FROM s_items""")(lambda t: ops.total_amount_check(_items(t)))
query("business_rule_counts", _SOILED + """
  SELECT count(*) FILTER (quantity <= 0) AS non_positive_quantity, count(*) FILTER (unit_price < 0) AS negative_price,
         (SELECT count(*) FROM s_inventory WHERE current_stock < 0) AS negative_stock FROM s_items""")(
    lambda t: ops.business_rule_counts(_items(t), _inventory(t)))
query("training_row_filter", _SOILED + """
  SELECT product_id, count(*) AS rows FROM s_items
  WHERE quantity > 0 AND unit_price > 0 AND discount IS NOT NULL AND tax IS NOT NULL GROUP BY 1""")(
    lambda t: ops.training_row_filter(_items(t)).groupBy("product_id").agg(F.count(F.lit(1)).alias("rows")))
query("status_predicates", """
  SELECT count(*) FILTER (order_status <> 'Cancelled') AS not_cancelled,
         count(*) FILTER (order_status = 'Delivered') AS delivered FROM orders_c""")(
    lambda t: t.orders.agg(F.count(F.when(not_cancelled(), 1)).alias("not_cancelled"),
                           F.count(F.when(delivered(), 1)).alias("delivered")))
