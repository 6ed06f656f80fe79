"""Run the orders pipeline from the command line, one environment at a time.

    python -m millrace.job update --env dev --user ada --source-path /landing/orders
    python -m millrace.job full-refresh --env tst --source-path /landing/orders
    python -m millrace.job release --env prd --source-path /landing/orders \\
        --tag 1.0.1 --requests governance.refresh_requests --tagger tess

    python -m millrace.job retire --env tst --source-path /landing/orders

``release`` carries out the full refresh a tag asks for, if it asks for one; in prd there is
no other. ``retire`` deletes superseded generations but the newest one.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from .plans import (
    Update,
    create_layers,
    full_refresh,
    governed_refresh,
    orders_pipeline,
    retire_generations,
    target,
    update,
)
from .session import pin
from .sources import landing_stream, scan, source_path

# Fixed value: the key refresh requests name this pipeline by.
PIPELINE_KEY = "orders_pipeline"


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="millrace.job", description=__doc__.splitlines()[0])
    parser.add_argument("action", choices=["update", "full-refresh", "release", "retire"])
    parser.add_argument("--env", default="dev", choices=["dev", "tst", "prd"])
    parser.add_argument("--user", help="whose databases to use in dev")
    parser.add_argument("--root", help="folder for new databases; default is the warehouse")
    parser.add_argument("--source-path", help="sets source_path; else the session must have it")
    parser.add_argument("--tag", help="release: the tag being released")
    parser.add_argument("--requests", help="release: table of refresh requests")
    parser.add_argument("--tagger", help="release: who set the tag")
    parser.add_argument("--approver", help="release: who approved the request")
    parser.add_argument("--run-link", help="release: where this run can be looked up")
    arguments = parser.parse_args(argv)
    if arguments.action == "full-refresh" and arguments.env == "prd":
        parser.error("prd is refreshed by an approved request only: use release")
    if arguments.action == "release":
        for name in ("tag", "requests", "tagger"):
            if getattr(arguments, name) is None:
                parser.error(f"release needs --{name}")
    return arguments


def main(argv: Sequence[str] | None = None) -> dict:
    asked = _arguments(argv)
    spark = pin(SparkSession.builder.appName("millrace").getOrCreate())
    if asked.source_path is not None:
        spark.conf.set("source_path", asked.source_path)
    landing = source_path(spark)
    create_layers(spark, asked.env, asked.user, asked.root)
    raw, bronze, ledger = (
        target(asked.env, "bronze", table, asked.user)
        for table in ("orders_raw", "orders_bronze", "refresh_ledger")
    )
    steps = orders_pipeline(lambda: landing_stream(spark, landing), raw, bronze)

    def described(done: Update) -> dict:
        counts = {table: asdict(counted) for table, counted in done.counts.items()}
        return {"generation": done.generation, "counts": counts}

    if asked.action == "retire":
        return {"retired": retire_generations(spark, bronze)}
    if asked.action == "update":
        return described(update(spark, steps))
    if asked.action == "full-refresh":
        return described(full_refresh(spark, steps))
    outcome = governed_refresh(
        spark,
        asked.tag,
        scan(spark, asked.requests, fresh=True),
        ledger,
        {PIPELINE_KEY: lambda: full_refresh(spark, steps).generation},
        tagger=asked.tagger,
        approver=asked.approver,
        run_link=asked.run_link,
    )
    return {"tag": asked.tag, "outcome": outcome}


if __name__ == "__main__":
    print(json.dumps(main()))
