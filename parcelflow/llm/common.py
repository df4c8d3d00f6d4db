"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, in the operators' contracts: a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder within spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a local session (as in tests) gets a temporary folder; a cluster gets an error, as its
    machines have no folder in common. The folder can be deleted when the application's results have been written.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or _local_dir()}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that losing an executor loses nothing.

    Its size isn't known to the planner, so joins with it are shuffled, and broadcast only where the shuffle shows it small.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As cut, for loops: a table, whose plan carries nothing of the rounds before and which forget can delete."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that kept has written and nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def fields(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [df["`" + c.replace("`", "``") + "`"] for c in df.columns]


#: Draws are whole numbers below this.
DRAWS = 1 << 62


def draw(*of: Column | str) -> Column:
    """A number of a row for bounded samples, evenly spread over values of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 2)


def last_draws(rows: DataFrame, group: str, sizes: dict, many: int) -> dict:
    """The many-th least draw of each group of rows(group, draw), or the greatest of fewer, for groups of known sizes.

    Rows that can't be among them are passed over by their draw; a group of which that leaves nothing, as its rows are
    equal, is looked at whole. Each task passes on many rows of a group at most.
    """

    def lasts(some: DataFrame) -> dict:
        place = F.row_number().over(Window.partitionBy(group).orderBy("draw"))
        least = some.select(group, "draw").withColumn("place", place).where(F.col("place") <= many)
        return {r[group]: r["last"] for r in least.groupBy(group).agg(F.max("draw").alias("last")).collect()}  # a row for each group

    if not sizes:
        return {}
    bound = F.element_at(F.create_map(*(F.lit(x) for g, n in sorted(sizes.items()) for x in (g, int(DRAWS * min(1.0, 4 * many / n))))), F.col(group))
    found = lasts(rows.where(F.col("draw") < bound))
    rest = [g for g in sizes if g not in found]
    return found | (lasts(rows.where(F.col(group).isin(rest))) if rest else {})
