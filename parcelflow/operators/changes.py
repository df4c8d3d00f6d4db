"""Changes of tables as DataFrames: the table after an insert, upsert, patch, delete or purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import kept_table


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """old and those of new whose key isn't there yet; the first of equal new keys goes in. A key with a null is never equal."""
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    keyed = new.where(whole).withColumn("nth", first).where("nth = 1").drop("nth").join(old.select(*key), key, "left_anti")
    return old.unionByName(keyed.select(*old.columns)).unionByName(new.where(~whole).select(*old.columns))


def numbered(rows: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """rows with whole numbers from start + 1 on, without gaps, in their order; ties in any.

    A range partitioning puts the rows in order; each partition counts its own, and what precedes it is a sum of counts,
    one for each partition. The sorted rows are a table first, so that a repeated task gives the same numbers.
    """
    spark = rows.sparkSession
    placed = kept_table(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, offsets = sorted((r.part, r.n) for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect()), start, []  # a row for each partition
    for k, n in sizes:
        offsets.append((k, before))
        before += n
    known = F.broadcast(spark.createDataFrame(offsets, "part long, before long"))
    return placed.withColumn("part", F.shiftright("at", 33)).join(known, "part").select((F.col("before") + within + 1).alias(name), *rows.columns)


def append_import(spark: SparkSession, path: str, rows: DataFrame, batch: str, order: list[str], key: str = "id") -> DataFrame:
    """The table at path after rows have been added under new ids, in order, as one batch.

    A batch is a folder of its own, which is written whole or not at all; a batch that is there already is not added
    again, so an import that is run twice, or was cut off, gives its rows once. Ids go on from the greatest.
    """
    folder = f"{path}/batch={batch}"
    if not _exists(spark, f"{folder}/_SUCCESS"):
        others = spark.read.parquet(path).where(F.col("batch") != batch) if _exists(spark, path) else None
        start = others.agg(F.coalesce(F.max(key), F.lit(0))).first()[0] if others is not None else 0
        numbered(rows, order, start, key).write.mode("overwrite").parquet(folder)
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last of new by order for each key, else the old row."""
    columns = [c for c in old.columns if c != key]
    latest = new.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("latest"))
    joined = old.join(latest, key, "full")
    return joined.select(key, *(F.when(F.col("latest").isNotNull(), F.col(f"latest.{c}")).otherwise(F.col(c)).alias(c) for c in columns))


def _last(changes: DataFrame, key: str, order: str | None) -> tuple[list[str], DataFrame]:
    """The changed columns, and for each key the last change by order (without one, the greatest) as the struct new."""
    changed = [c for c in changes.columns if c not in (key, order)]
    new = F.struct(*changed)
    return changed, changes.groupBy(key).agg((F.max_by(new, order) if order else F.max(new)).alias("new"))


def patch(old: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Non-null values of the last of changes(key, ...) over old's: a null can't clear a field."""
    changed, new = _last(changes, key, order)
    joined = old.join(new, key, "left")
    return joined.select(*(F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns))


def overwrite(old: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Values of the last of changes over old's where a change exists, nulls too; other columns stay."""
    changed, new = _last(changes, key, order)
    joined = old.join(new, key, "left")
    return joined.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns))


def drop_repeats(df: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """The row with the least id of each key; nulls are equal here."""
    return df.join(df.groupBy(*key).agg(F.min(order).alias(order)).select(order), order, "left_semi")


def keep_newer(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows that aren't older than the cutoff; those without a time stay."""
    return df.where(~F.coalesce(F.col(column) < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False)))


def retention(shipments: DataFrame, today: str, months: int, warn_days: int) -> DataFrame:
    """Delivered shipments with due date and state: due, warning or kept."""
    due = F.to_date(F.add_months("delivered_at", months))
    day = F.to_date(F.lit(today))
    state = F.when(due <= day, "due").when(due <= F.date_add(day, warn_days), "warning").otherwise("kept")
    return shipments.where("delivered_at is not null").select("id", due.alias("due"), state.alias("state"))


def purge(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent isn't among the gone."""
    return children.join(gone.select(key), key, "left_anti")
