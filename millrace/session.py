"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

# Strict casts fail the job only under ANSI rules, and zone-less timestamp text
# is read in the session zone, so both are part of the results.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Apply the settings that results depend on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def require_settings(spark: SparkSession) -> None:
    """Refuse a session in which timestamps would silently become NULL or shift."""
    if spark.conf.get("spark.sql.ansi.enabled").lower() != "true":
        raise ValueError("spark.sql.ansi.enabled must be true; strict casts depend on it")
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC, not {zone}; times without a zone depend on it")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the folder that every executor can reach.

    The folder is ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder, because there the driver's disk is the
    executors' disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not local and (not base or base.startswith("file:")):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share, which no file: path is")
    if not base:
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/millrace/{purpose}-{uuid4().hex}"
