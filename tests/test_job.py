import json

import pytest

from millrace.job import main
from millrace.plans import target
from millrace.sources import scan


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    return folder


def land(folder, name, *ids):
    line = {"customer_id": "c", "amount": "1", "order_ts": "2026-01-01"}
    (folder / name).write_text("".join(json.dumps({"order_id": n, **line}) + "\n" for n in ids))


def test_update_refresh_and_release(spark, landing, tmp_path):
    common = ["--env", "dev", "--user", "job", "--root", str(tmp_path), "--source-path", str(landing)]
    bronze = target("dev", "bronze", "orders_bronze", "job")
    land(landing, "a.json", 1, 2, None)
    try:
        first = main(["update", *common])
        assert first["counts"][bronze] == {"seen": 3, "dropped": 1, "failed": {"valid_order_id": 1}}
        land(landing, "b.json", 3)
        assert main(["update", *common])["generation"] == first["generation"]
        assert main(["full-refresh", *common])["generation"] != first["generation"]
        assert spark.table(bronze).count() == 3

        requests = target("dev", "silver", "requests", "job")
        spark.createDataFrame(
            [("orders_pipeline", "1.0.1", "put right")],
            "pipeline_key STRING, release_version STRING, reason STRING",
        ).write.saveAsTable(requests)
        release = ["release", *common, "--requests", requests, "--tagger", "tess"]
        land(landing, "b.json", 4, 5)
        assert main([*release, "--tag", "1.0.0"])["outcome"] == "SKIP"
        assert main([*release, "--tag", "1.0.1"])["outcome"] == "COMPLETED"
        assert main([*release, "--tag", "1.0.1"])["outcome"] == "BLOCKED"
        ids = sorted(r["order_id"] for r in scan(spark, bronze, fresh=True).collect())
        assert ids == ["1", "2", "4", "5"]
    finally:
        spark.conf.unset("source_path")


def test_what_is_missing_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="SQL_CONF_NOT_FOUND"):
        main(["update", "--env", "tst", "--root", str(tmp_path)])
    with pytest.raises(SystemExit):
        main(["release", "--env", "tst", "--tag", "1.0.1"])
    with pytest.raises(SystemExit):
        main(["full-refresh", "--env", "prd", "--source-path", str(tmp_path)])


def test_superseded_generations_are_retired_when_asked(spark, landing, tmp_path):
    common = ["--env", "dev", "--user", "retire", "--root", str(tmp_path), "--source-path", str(landing)]
    land(landing, "a.json", 1)
    try:
        first = main(["update", *common])["generation"]
        second = main(["full-refresh", *common])["generation"]
        third = main(["full-refresh", *common])["generation"]
        assert main(["retire", *common]) == {"retired": [first]}
        assert main(["update", *common])["generation"] == third != second
    finally:
        spark.conf.unset("source_path")
