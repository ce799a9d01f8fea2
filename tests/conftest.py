import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallygrid.session import local_session
    return local_session("tests", cores="8", shuffle_partitions=4)


@pytest.fixture
def at():
    """Timestamp from a short text."""
    return lambda text: dt.datetime.fromisoformat(text)


@pytest.fixture
def sales_of(spark):
    """Order lines from (product, customer, date, quantity, amount[, status]) tuples."""
    def build(rows):
        full = [(i, 1, dt.datetime.fromisoformat(r[2]), r[1], r[0], r[3], float(r[4]) / max(r[3], 1), float(r[4]),
                 float(r[4]) * 0.2, 20.0, r[5] if len(r) > 5 else "Delivered") for i, r in enumerate(rows)]
        return spark.createDataFrame(full, (
            "order_id long, line_no int, order_date timestamp_ntz, customer_id string, product_id string, quantity int, "
            "unit_price double, total_amount double, profit double, profit_margin double, order_status string"))
    return build


@pytest.fixture
def products_of(spark):
    """Products from (id, stock, threshold, cost, price, active) tuples."""
    def build(rows):
        full = [(r[0], f"Name {r[0]}", "Cat", "Brand", float(r[4]), None if r[3] is None else float(r[3]), r[1], 100, r[2], 50,
                 "In Stock", r[5]) for r in rows]
        return spark.createDataFrame(full, (
            "product_id string, product_name string, category string, brand string, unit_price double, cost_price double, "
            "current_stock int, initial_stock int, reorder_threshold int, reorder_quantity int, stock_status string, is_active boolean"))
    return build
