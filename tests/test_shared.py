"""Files and databases where executors are processes of their own, and paths are Hadoop URIs."""

import datetime

import pyarrow as pa
import pytest

from millrace.sources import files, jdbc


def test_arrow_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_ARROW_FILE", 1 << 14)
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.range(0, 9000, 1, 3).selectExpr("id", "IF(id % 7 = 0, NULL, sha2(string(id), 256)) AS s", "unhex(hex(id)) AS b", "array(id, -id) AS a", f"TIMESTAMP '{when}' AS at", "named_struct('x', id / 3) AS n")
    uri = f"file://{tmp_path}/new folder/a.arrow"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "500")
    files.write_arrow(df.where("id NOT BETWEEN 0 AND 2999"), uri)
    spark.conf.set(key, before)
    back = files.read_arrow(spark, uri)
    assert back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.where("id >= 3000").collect()))
    parts = sorted((tmp_path / "new folder" / "a.arrow").glob("part-*"))
    assert len(parts) == 13 and sum(pa.ipc.open_file(str(p)).read_all().num_rows for p in parts) == 6000
    assert len({str(pa.ipc.open_file(str(p)).schema) for p in parts}) == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        files.save(df, uri)
    files.save(df.where("id < 0"), uri, "overwrite")
    assert files.load(spark, uri).count() == 0 and files.load(spark, uri).dtypes == df.dtypes


def test_excel_at_uris(spark, tmp_path):
    df = spark.createDataFrame([(i, f"<{i}> & \u00e9", i / 4) for i in range(3000)], "i int, s string, x double")
    uri = f"file://{tmp_path}/new folder/b.xlsx"
    files.write_excel(df, uri, "a & b")
    assert files.list_sheets(uri) == ["a & b"]
    assert sorted(files.read_excel(spark, uri, "a & b").collect()) == sorted(df.collect())
    files.write_excel(df.limit(2), uri)
    assert files.load(spark, uri).count() == 2 and [p.name for p in (tmp_path / "new folder").iterdir()] == ["b.xlsx"]


@pytest.mark.parametrize("block", [7, 20_000])
def test_database_of_the_driver(spark, monkeypatch, block):
    """As on a cluster: neither reads nor writes of an embedded database run in a task."""
    monkeypatch.setattr(jdbc, "drivers_own", lambda spark, options: True)
    monkeypatch.setattr(jdbc, "_BLOCK", block)
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.range(0, 50, 1, 3).selectExpr("id", "IF(id % 7 = 0, NULL, concat('\u00e9 ', id)) AS s", "id / 3 AS x", "id % 2 = 0 AS even", f"TIMESTAMP '{when}' AS at", "CAST(id AS decimal(9, 2)) AS d", "CAST(string(id) AS binary) AS b")
    options = {"url": f"jdbc:derby:memory:own{block};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.to_sql(df, options, "t", batch_size=3)
    scan = jdbc.Scanner(spark, options, "t")
    assert scan.schema().simpleString() == df.schema.simpleString() and sorted(scan.frame().collect()) == sorted(df.collect())
    assert [r.id for r in scan.scan(["id"], "id > 40", ["id"], 3, True).collect()] == [41, 42, 43]
    with pytest.raises(Exception, match="(?i)already exists"):
        jdbc.to_sql(df, options, "t")
    jdbc.to_sql(df, options, "t", "ignore")
    assert scan.count() == 50
    jdbc.to_sql(df.where("id < 9"), options, "t", "append")
    assert scan.count() == 59 and jdbc.read_sql(spark, options, 'SELECT "s" FROM t WHERE "id" = 8').count() == 2
    jdbc.to_sql(df.where("id < 0"), options, "t", "overwrite")
    assert scan.count() == 0 and scan.frame().dtypes == df.dtypes


def test_which_databases_are_the_drivers(spark):
    class Cluster:
        class sparkContext:
            master = "local-cluster[3,2,3000]"

    inside = ["jdbc:derby:memory:x;create=true", "jdbc:derby:/data/x", "jdbc:sqlite:/x.db", "jdbc:h2:mem:x", "jdbc:hsqldb:mem:x"]
    served = ["jdbc:derby://host:1527/x", "jdbc:h2:tcp://host/x", "jdbc:hsqldb:hsql://host/x", "jdbc:postgresql://host/x"]
    assert [jdbc.drivers_own(Cluster, {"url": u}) for u in inside + served] == [True] * 5 + [False] * 4
    assert not any(jdbc.drivers_own(spark, {"url": u}) for u in inside)
