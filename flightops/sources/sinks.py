"""S-6 publish (full replace, or lossless merge of a landing) and S-10 CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.session import new_scratch_path


def publish_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None) -> None:
    """Write ``df`` as Parquet, replacing the whole table that was there (the reference's
    ``if_exists='replace'``), with or without partition folders. ``merge_table`` adds a
    landing to a table instead.

    Partitioned writes go through a REBALANCE on the partition columns: rows of one
    partition meet in few tasks (few files per folder), and AQE splits a partition that
    is too large (a day holding a third of all rows) over several tasks and merges small
    ones. Unlike a range repartition there is no sampling pass, so the upstream plan
    (a JSON parse, a join) runs once.
    """
    _write(df, path, partition_by, "static")


def _columns(partition_by: str | list[str] | None) -> list[str]:
    return [partition_by] if isinstance(partition_by, str) else list(partition_by or [])


def _write(df: DataFrame, path: str, partition_by: str | list[str] | None, overwrite: str) -> None:
    cols = _columns(partition_by)
    if cols:
        df = df.hint("rebalance", *cols)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", overwrite).option("compression", "zstd")
    (writer.partitionBy(*cols) if cols else writer).parquet(path)


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def merge_table(df: DataFrame, path: str, partition_by: str | list[str], owner: list[str],
                owners: DataFrame | None = None) -> None:
    """Add ``df`` to the partitioned table at ``path``, replacing exactly the rows whose
    ``owner`` columns (NULL equals NULL) occur in ``df`` or in ``owners``: a landing owns its
    windows, also those without a row now, a rollup its days. All other rows stay, also those
    that share a partition with new ones.

    Only partitions that gain or lose rows are rewritten, through a staged copy in the
    shared folder (a table can't be overwritten while it is read). A partition that loses
    its last row is removed.
    """
    spark = df.sparkSession
    cols = _columns(partition_by)
    where = _hadoop_path(spark, path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        publish_table(df, path, cols)
        return
    staged_new = new_scratch_path(spark, "merge-new")
    df.write.parquet(staged_new)
    new = spark.read.schema(df.schema).parquet(staged_new)
    old = spark.read.parquet(path).withColumn("_folder", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    owned = new.select(*owner)
    owners = (owned if owners is None else owned.unionByName(owners.select(*owner))).distinct()
    lost = old.join(owners, _same(old, owners, owner), "left_semi")
    touched = new.select(*cols).unionByName(lost.select(*cols)).distinct()
    # one row a partition folder that the landing changes
    folders = {r["_folder"] for r in lost.select("_folder").distinct().collect()}
    stays = old.join(touched, _same(old, touched, cols), "left_semi")
    stays = stays.join(owners, _same(stays, owners, owner), "left_anti").drop("_folder")
    staged = new_scratch_path(spark, "merge")
    stays.unionByName(new, allowMissingColumns=True).write.parquet(staged)
    merged = spark.read.parquet(staged)
    _write(merged, path, cols, "dynamic")
    if folders:
        _drop_emptied(spark, merged, path, cols, folders)
    for p in (staged_new, staged):
        gone = _hadoop_path(spark, p)
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def _drop_emptied(spark: SparkSession, merged: DataFrame, path: str, cols: list[str],
                  folders: set[str]) -> None:
    """Remove those of ``folders`` whose partition has no row in ``merged``."""
    old = spark.read.parquet(path).withColumn(
        "_folder", F.regexp_replace(F.input_file_name(), "/[^/]*$", ""))
    left = merged.select(*cols).distinct()
    empty = old.join(left, _same(old, left, cols), "left_anti").select("_folder").distinct().collect()
    for r in empty:
        if r["_folder"] in folders:
            gone = _hadoop_path(spark, r["_folder"])
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def export_csv(df: DataFrame, path: str) -> None:
    """S-10: CSV with a header row and no index column.

    NULL and empty text are both written as an empty field, as pandas ``to_csv`` does.
    The output is one file per task; a folder of parts is the scalable form of the single
    download file.
    """
    # Times as the reference stores and exports them: 'YYYY-MM-DD HH:MM:SS'.
    (df.write.mode("overwrite")
     .option("header", True)
     .option("emptyValue", "")
     .option("nullValue", "")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(path))
