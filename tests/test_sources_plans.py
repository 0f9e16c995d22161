import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabkit.functions.kinds import normalise_nulls
from tabkit.operators import evaluate as V
from tabkit.operators import hygiene as H
from tabkit.operators import profile as P
from tabkit.operators import split as M
from tabkit.sources import files, jdbc
from tabkit.streaming import scoring  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_latin1_file(spark, tmp_path):
    path = tmp_path / "latin1.csv"
    path.write_bytes("name,x\ncafé,1\n".encode("latin1"))
    assert files.detect_encoding(spark, str(path)) == "latin1"
    assert [tuple(r) for r in files.read_csv(spark, str(path)).collect()] == [("café", 1)]


def test_utf8_file_with_a_replacement_character_stays_utf8(spark, tmp_path):
    path = tmp_path / "utf8.csv"
    path.write_text("name,x\ncafé �,1\n", encoding="utf-8")
    assert files.detect_encoding(spark, str(path)) == "utf-8"
    assert files.read_csv(spark, str(path)).first()["name"] == "café �"


def test_csv_keeps_quotes_line_breaks_and_nan_is_null(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"\nthere, you', 1.5), ("b", float("nan")), (None, None)], "t string, x double")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_csv(spark, str(tmp_path / "out"), schema="t string, x double", multi_line=True)
    assert sorted(back.collect(), key=str) == sorted(normalise_nulls(df).collect(), key=str)


def test_scoring_csv_takes_types_from_the_features(spark, tmp_path):
    (tmp_path / "s.csv").write_text("extra,x,t\n7,oops,1\n8,2.5,2\n")
    schema = spark.createDataFrame([], "t string, x double").schema
    found = files.read_scoring_csv(spark, str(tmp_path / "s.csv"), schema)
    assert dict(found.dtypes) == {"extra": "string", "x": "double", "t": "string"}
    assert [r["x"] for r in found.orderBy("t").collect()] == [None, 2.5]


def test_csv_missing_markers_leave_columns_numeric(spark, tmp_path):
    (tmp_path / "m.csv").write_text("i,x,big,b,day,t\n1,NA,99999999999,true,2024-01-02,NULL\nn/a,2.5,1,False,nan,u\n3,-1e3,2,None,2024-02-03,\n")
    found = files.read_csv(spark, str(tmp_path / "m.csv"))
    assert [t for _, t in found.dtypes] == ["int", "double", "bigint", "boolean", "date", "string"]
    assert [(r["i"], r["x"], r["t"]) for r in found.orderBy("big").collect()] == [(None, 2.5, "u"), (3, -1000.0, None), (1, None, None)]
    kept = files.read_csv(spark, str(tmp_path / "m.csv"), missing=())
    assert dict(kept.dtypes)["x"] == "string"


def test_csv_finds_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('t,x\n"a\nb",1\n"say ""hi""",2\n')
    assert files.has_quoted_breaks(spark, str(tmp_path / "q.csv"))
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "q.csv")).collect()) == [("a\nb", 1), ('say "hi"', 2)]
    scored = files.read_scoring_csv(spark, str(tmp_path / "q.csv"), spark.createDataFrame([], "x double").schema)
    assert sorted(tuple(r) for r in scored.collect()) == [("a\nb", 1.0), ('say "hi"', 2.0)]
    (tmp_path / "p.csv").write_text('t,x\n"a, b",1\n')
    assert not files.has_quoted_breaks(spark, str(tmp_path / "p.csv"))


def test_csv_rows_of_wrong_length_are_an_error_unless_permitted(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(tmp_path / "w.csv")).collect()
    found = files.read_csv(spark, str(tmp_path / "w.csv"), mode="PERMISSIVE")
    assert sorted((tuple(r) for r in found.collect()), key=str) == [(1, 2), (3, 4), (6, None)]


def test_csv_without_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    found = files.read_csv(spark, str(tmp_path / "e.csv"))
    assert found.dtypes == [("a", "string"), ("b", "string")] and found.count() == 0


def test_jdbc_urls_and_identifiers():
    assert jdbc.jdbc_url("PostgreSQL", "db", "h") == "jdbc:postgresql://h:5432/db"
    assert jdbc.jdbc_url("MySQL", "db", "h", 1) == "jdbc:mysql://h:1/db"
    assert jdbc.jdbc_url("SQLite", "/a.db") == "jdbc:sqlite:/a.db"
    with pytest.raises(ValueError):
        jdbc.jdbc_url("Oracle", "db", "h")
    assert jdbc.checked_identifier("public.orders") == "public.orders"
    for bad in ("orders; DROP TABLE x", "a b", "(SELECT 1)", ""):
        with pytest.raises(ValueError):
            jdbc.checked_identifier(bad)


class FakeReader:
    def __init__(self, frame, log):
        self.frame, self.log = frame, log

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.log.append(options)
        return self

    def load(self):
        query = self.log[-1].get("query", "")
        return self.frame.agg(F.min("id").alias("low"), F.max("id").alias("high")) if "MIN(" in query else self.frame


def test_jdbc_reads_in_slices(spark, monkeypatch):
    log = []
    fake = type("Session", (), {"read": FakeReader(spark.range(5, 100), log)})()
    jdbc.read_jdbc(fake, "jdbc:x", "orders", partition_column="id", num_partitions=8)
    assert log[0]["query"] == "SELECT MIN(id) AS low, MAX(id) AS high FROM orders"
    assert (log[1]["lowerBound"], log[1]["upperBound"], log[1]["numPartitions"]) == ("5", "99", "8")


def test_list_tables_of_the_catalog(spark, table):
    table("nation").createOrReplaceTempView("some_nations")
    assert "some_nations" in [r["table_name"] for r in jdbc.list_tables(spark).collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projections_reach_the_scan(table):
    text = plan(P.missing_summary(table("lineitem").select("l_quantity", "l_tax")))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text


def test_removing_outliers_is_one_filtered_scan(table):
    text = plan(H.remove_outliers(table("lineitem"), ["l_quantity", "l_discount"]))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Join" not in text


def test_split_and_folds_do_not_shuffle_the_table(table):
    for df in (
        M.assign_split(table("orders"), "o_orderkey", stratify="o_orderstatus"),
        M.assign_folds(table("orders"), "o_orderkey", 5, stratify="o_orderstatus"),
        M.assign_split(table("orders"), "o_orderkey"),
    ):
        text = plan(df)
        assert "hashpartitioning" not in text and "Window" not in text and text.count("FileScan") == 1


def test_value_counts_read_each_column_once_and_combine_before_the_shuffle(spark, table):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(P.column_profile(table("lineitem")))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = [c for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in re.findall(r"(\w+):", schema)]
    assert sorted(read) == sorted(table("lineitem").columns)
    assert text.count("partial_count") >= 3


def test_no_python_functions_in_the_table_operators(spark, table):
    scored = table("lineitem").selectExpr("CAST(l_discount >= 0.05 AS INT) AS label", "CAST(l_quantity > 25 AS INT) AS prediction", "l_quantity AS score")
    for df in (
        P.column_profile(table("orders")), P.validate(table("orders")), P.duplicate_count(table("orders")),
        H.detect_unwanted(table("orders")), H.impute_mode(table("orders")), H.cap_outliers(table("events"), ["value"]),
        V.classification_report(scored), V.roc_curve(scored), V.auc(scored),
    ):
        assert "Python" not in plan(df) and "Pandas" not in plan(df)
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_windows_over_raw_rows_are_partitioned(table):
    """The only window without a partition ranks rows that are already one per score."""
    scored = table("lineitem").selectExpr("1 AS label", "l_quantity AS score")
    text = plan(V.roc_curve(scored))
    aggregate, window = text.rindex("HashAggregate"), text.index("Window")
    assert window < aggregate


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 11
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in queries)


def test_checkpoint_folder_comes_from_the_session(spark):
    from tabkit.session import cut_lineage, ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark) == folder
    assert cut_lineage(spark.range(3)).count() == 3
    assert "file://" in files.read_parquet(spark, f"{SF}/nation.parquet").inputFiles()[0]
