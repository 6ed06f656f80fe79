from .generations import Generation, current_generation, new_generation, retire_generations, show
from .governed import BLOCKED, AmbiguousRequest, LedgerTampered, governed_refresh
from .journal import Shown, begin, move_tables, settle
from .leases import NothingToRead, reading
from .order import CircularTables, UnknownTable, in_order
from .pipelines import NotUpdatable, Step, Update, full_refresh, orders_pipeline, recompute, update
from .targets import create_layers, database, target

__all__ = [
    "BLOCKED",
    "AmbiguousRequest",
    "CircularTables",
    "Generation",
    "LedgerTampered",
    "NotUpdatable",
    "NothingToRead",
    "Shown",
    "Step",
    "UnknownTable",
    "Update",
    "begin",
    "create_layers",
    "current_generation",
    "database",
    "full_refresh",
    "governed_refresh",
    "in_order",
    "move_tables",
    "new_generation",
    "orders_pipeline",
    "reading",
    "recompute",
    "retire_generations",
    "settle",
    "show",
    "target",
    "update",
]
