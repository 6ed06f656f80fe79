from .exclusive import Taken
from .inline import SAMPLE_ORDERS, SAMPLE_SCHEMA, orders_raw
from .landing import LANDED_ORDERS, landing_path, landing_stream, read_landing, source_path
from .tables import scan, scan_new_files

__all__ = [
    "LANDED_ORDERS",
    "SAMPLE_ORDERS",
    "SAMPLE_SCHEMA",
    "Taken",
    "landing_path",
    "landing_stream",
    "orders_raw",
    "read_landing",
    "scan",
    "scan_new_files",
    "source_path",
]
