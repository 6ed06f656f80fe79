"""Names of databases and tables per environment and layer."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Environments with the prefix of their databases, and layers.
DATABASE_PREFIX = {"dev": "orders_dev", "tst": "orders_tst", "prd": "orders_prd"}
LAYERS = {
    "bronze": "Raw arrivals and the cleaned tables made from them.",
    "silver": "Tables modelled on top of bronze.",
}
# No underscore in user names: it separates the parts of a database name.
_USER = re.compile(r"[a-z][a-z0-9]*")
_TABLE = re.compile(r"[a-z][a-z0-9_]*")


def database(env: str, layer: str, user: str | None = None) -> str:
    """Database of a layer. In dev every user has databases of their own; elsewhere nobody has."""
    if env not in DATABASE_PREFIX:
        raise ValueError(f"environment must be one of {sorted(DATABASE_PREFIX)}, not {env!r}")
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {sorted(LAYERS)}, not {layer!r}")
    if env != "dev":
        if user is not None:
            raise ValueError(f"databases in {env} are shared and carry no user name")
        return f"{DATABASE_PREFIX[env]}_{layer}"
    if user is None or not _USER.fullmatch(user):
        raise ValueError(f"databases in dev need a user name of letters and digits, not {user!r}")
    return f"{DATABASE_PREFIX[env]}_{user}_{layer}"


def target(env: str, layer: str, table: str, user: str | None = None) -> str:
    """Qualified table name: the same code writes elsewhere by environment alone."""
    if not _TABLE.fullmatch(table):
        raise ValueError(f"not a table name: {table!r}")
    return f"{database(env, layer, user)}.{table}"


def create_layers(
    spark: SparkSession, env: str, user: str | None = None, root: str | None = None
) -> None:
    """Create the databases of an environment, below ``root`` or else in the warehouse."""
    for layer, comment in LAYERS.items():
        name = database(env, layer, user)
        where, args = "", {"comment": comment}
        if root is not None:
            where, args["location"] = "LOCATION :location", f"{root.rstrip('/')}/{name}"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} COMMENT :comment {where}", args=args)
