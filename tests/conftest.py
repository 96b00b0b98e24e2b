import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.session import get_session, shared_dir  # noqa: E402

ORDER_SCHEMA = ("productid string, sellerid string, merchantid string, year int, month int, week int, "
                "day int, attrs string, channel string, price double, disprice double, finalprice double, "
                "productcount bigint, eventcount int, stock int")
VIEW_SCHEMA = ("productid string, sellerid string, merchantid string, year int, month int, week int, "
               "day int, brand string, channel string, fastseller string, price double, disprice double, "
               "eventcount int, productcount int, scorefive int, scorefour int, scorethree int, "
               "scoretwo int, scoreone int, sellergrade int")


@pytest.fixture(scope="session")
def spark():
    session = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    shared_dir(session)
    yield session


def _order(pid, price, stock, count):
    return (pid, "S1", "M1", 2016, 8, 35, 29, "x", "web", price, price, price, count, 1, stock)


def _view(pid, merchant, brand, five, four, three, two, one, grade):
    return (pid, "S1", merchant, 2016, 8, 35, 29, brand, "web", "no", 10.0, 10.0, 1, 1,
            five, four, three, two, one, grade)


@pytest.fixture(scope="session")
def tiny_orders(spark):
    """FIXTURES.md §3 orders o1..o4."""
    rows = [_order("P1", 3500.0, 5, 2), _order("P1", 3000.0, 3, 3),
            _order("P2", None, None, 25), _order("P3", 2000.0, 4, 19)]
    return spark.createDataFrame(rows, ORDER_SCHEMA)


@pytest.fixture(scope="session")
def tiny_views(spark):
    """FIXTURES.md §3 views."""
    rows = [_view("P1", "M1", "A", 5, 4, 3, 2, 1, 9), _view("P1", None, "A", 7, 6, 5, 4, 3, 7),
            _view("P1", "M2", "B", 1, 1, 1, 1, 1, 5), _view("P3", "M1", None, 2, 2, 2, None, 2, 4)]
    return spark.createDataFrame(rows, VIEW_SCHEMA)
