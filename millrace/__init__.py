"""Landing, cleaning and refreshing order tables with PySpark."""

from .operators import VALID_ORDER_ID, Expectation, transform_orders
from .plans import full_refresh, governed_refresh, orders_pipeline, recompute, target, update
from .session import pin
from .sources import landing_stream, orders_raw, read_landing, source_path

__all__ = [
    "VALID_ORDER_ID",
    "Expectation",
    "full_refresh",
    "governed_refresh",
    "landing_stream",
    "orders_pipeline",
    "orders_raw",
    "pin",
    "read_landing",
    "recompute",
    "source_path",
    "target",
    "transform_orders",
    "update",
]
