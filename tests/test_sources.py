import pytest
from pyspark.sql import functions as F

from pairset import schema
from pairset.sources import tables
from tests.conftest import rows


def test_ids_keep_their_zeros(spark, out):
    df = spark.createDataFrame([("0000427", 15589898059857, 0.0199)], "id string, product_id bigint, garment_score double")
    tables.write_csv(df, f"{out}/m")
    got = tables.read_manifest(spark, f"{out}/m", df.schema)
    assert rows(got) == [("0000427", 15589898059857, 0.0199)]


def test_a_manifest_with_other_columns_fails(spark, out):
    tables.write_csv(spark.range(3).select(F.col("id").alias("other")), f"{out}/m")
    with pytest.raises(Exception):
        tables.read_manifest(spark, f"{out}/m", schema.struct_of("id string")).collect()


def test_nan_becomes_null_at_the_door(spark, out):
    spark.createDataFrame([("a", float("nan"))], "id string, garment_score double").write.parquet(f"{out}/i")
    index = tables.read_index(spark, f"{out}/i")
    assert index.schema == schema.PAIR_INDEX or index.columns == schema.PAIR_INDEX.names
    row = index.first()
    assert row["garment_score"] is None and row["title"] is None


def test_metadata_round_trip(spark, out):
    df = spark.createDataFrame([(240, "masked", 0.67)], "n bigint, mode string, ssim double")
    tables.write_metadata(df, f"{out}/meta")
    assert rows(tables.read_metadata(spark, f"{out}/meta", df.schema)) == [(240, "masked", 0.67)]
    many = spark.range(40).repartition(4).select(F.col("id").alias("n"), F.lit("m").alias("mode"), F.lit(0.5).alias("ssim"))
    tables.write_metadata(many, f"{out}/groups")
    assert tables.read_metadata(spark, f"{out}/groups", df.schema, multi_line=False).count() == 40


def test_append_and_partitioned_tables(spark, out):
    df = spark.createDataFrame([("a", "train"), ("b", "val")], "id string, part string")
    tables.write_splits(df, f"{out}/s")
    train = spark.read.parquet(f"{out}/s").where("part = 'train'")
    assert rows(train, "id") == [("a",)]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan
    tables.append_table(df, f"{out}/t")
    tables.append_table(df, f"{out}/t")
    assert spark.read.parquet(f"{out}/t").count() == 4


def test_schema_helpers(spark):
    df = spark.range(1)
    assert schema.present(df, ["x", "id"]) == ["id"]
    with pytest.raises(ValueError):
        schema.require_columns(df, ["id", "x"])


def test_text_columns_are_coerced(spark):
    df = spark.createDataFrame([("1", " 2.5", "true", "x"), ("one", "nan", "maybe", None)], "a string, b string, c string, d string")
    typed = schema.coerced(df, schema.struct_of("a int, b double, c boolean, d string"))
    assert [tuple(r) for r in typed.collect()] == [(1, 2.5, True, "x"), (None, None, None, None)]


def test_log_times(spark):
    from pairset.functions import logs

    df = spark.createDataFrame([("2026-01-02 03:04:05 - INFO - x",), ("no time",)], "line string")
    got = df.select(logs.run_name("overfit", logs.logged_at(F.col("line")))).collect()
    assert [r[0] for r in got] == ["overfit_20260102_030405", None]
