import os

from tavla.session import cut, discard, ensure_checkpoint_dir, seen, ship


def local(path):
    return path.replace("file://", "").replace("file:", "")


def test_cut_keeps_rows_and_forgets_lineage(spark, rows):
    df = spark.createDataFrame([(1, ["a", None], None), (2, [], 0.5)], "i int, l array<string>, d double")
    kept = cut(df)
    assert kept.dtypes == df.dtypes
    assert rows(kept) == rows(df)
    assert "parquet" in kept._jdf.queryExecution().toString().lower()
    path = local(kept._tavla_path)
    assert os.path.isdir(path)
    discard(kept)
    assert not os.path.exists(path)
    discard(df)  # no table of ours: nothing happens


def test_cut_of_an_empty_frame(spark):
    empty = cut(spark.createDataFrame([], "i int, s string"))
    assert empty.count() == 0
    assert empty.dtypes == [("i", "int"), ("s", "string")]
    assert empty.isEmpty()


def test_cut_counts_while_writing(spark):
    from pyspark.sql import functions as F

    odd = F.count_if(F.col("id") % 2 == 1)
    kept = cut(spark.range(7), n=F.count(F.lit(1)), odd=odd)
    assert (seen(kept, "n"), seen(kept, "odd"), kept.count()) == (7, 3, 7)
    empty = cut(spark.createDataFrame([], "id int").where("id > 3").groupBy("id").count(), n=F.count(F.lit(1)))
    assert seen(empty, "n") == 0
    assert seen(cut(spark.range(1)), "n") == 0


def test_the_folder_is_named_once(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_the_package_is_sent_once(spark):
    ship(spark)
    sent = list(spark.sparkContext.listFiles)
    ship(spark)
    assert list(spark.sparkContext.listFiles) == sent
    assert any(f.endswith("tavla.zip") for f in sent)
