import gzip

import pytest

from metricloom.operators.quality import table_overview
from metricloom.sources.tables import inline_rows, load, read_csv, run_sql, shared_path, write_extract


def test_csv_with_index_padded_header_and_thousands(spark, tmp_path, rows):
    path = tmp_path / "x.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write(";  Name ;Funding Total\n0;a;1,000\n1;b;\n")
    df = read_csv(spark, str(path), "_c0 int, `  Name ` string, `Funding Total` string", sep=";", index="drop", tidy_headers=True)
    assert df.columns == ["name", "funding_total"] and rows(df) == [("a", "1,000"), ("b", None)]
    assert read_csv(spark, str(path), "_c0 int, n string, f string", sep=";", index="id").columns == ["id", "n", "f"]


def test_extract_is_partitioned_and_never_overwrites(spark, tmp_path, rows):
    df = inline_rows(spark, [("m", 1), ("s", 2)], "city string, n int")
    path = write_extract(df, str(tmp_path / "out"), ["city"])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["city=m", "city=s"]
    assert rows(spark.read.parquet(path).select("city", "n")) == [("m", 1), ("s", 2)]
    with pytest.raises(Exception):
        write_extract(df, path)


def test_shared_path_follows_the_cluster_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b
    if base:
        assert a.startswith(base.rstrip("/"))


def test_overview_and_views(spark, tmp_path):
    inline_rows(spark, [(1, "a"), (2, None)], "id int, s string").write.parquet(str(tmp_path / "t.parquet"))
    got = [tuple(r) for r in table_overview(load(spark, str(tmp_path), "t")).collect()]
    assert got == [(1, "id", "int", 2), (2, "s", "string", 2)]
    spark.range(7).createOrReplaceTempView("t")
    assert run_sql(spark, str(tmp_path), "select count(s) from {t}", ["t"]).first()[0] == 1
    assert spark.sql("select count(*) from t").first()[0] == 7          # a view of the user's stays
