"""Helpers shared by the text operators: stored intermediates and global positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType

from weftline.session import ensure_checkpoint_dir, ship_package

#: The separators of words in every contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: Copies of a key's total where rows of one key may be a large share of all.
SALT = 32
SPACE_CLASS = r"[ \t\n\x0B\f\r]"


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: computed once, prunable by column, safe when executors are lost."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getName().startswith("table-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """The same rows; filters put on the result stay above it, where costly columns are already computed once."""
    return df.withColumn("_settled", F.monotonically_increasing_id()).where("_settled >= 0").drop("_settled")


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the workers and keep Arrow batches small in rows and bytes, since single texts can be very long."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 512:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Names of types with Spark's and Arrow's.
TYPES = {"string": (StringType(), pa.string()), "binary": (BinaryType(), pa.binary()), "long": (LongType(), pa.int64()), "int": (IntegerType(), pa.int32()), "double": (DoubleType(), pa.float64())}


def computed(df: DataFrame, keep: list[str], use: list[str], make: Callable[[], Callable], made: str) -> DataFrame:
    """``keep`` as they are, and the columns ``made`` from the columns ``use``, one row for each row.

    ``make()`` runs once in a task and gives a function of lists (one for each column of ``use``) that returns arrays. The kept columns
    stay in Arrow: an integer beside a null is not turned into a floating-point number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            found = work(*[batch.column(c).to_pylist() for c in use])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(v, t) for v, t in zip(found, types)]], names=[*keep, *names])

    schema = df.select(*keep).schema
    for part in made.split(", "):
        schema = schema.add(part.split(" ")[0], TYPES[part.split(" ")[1]][0])
    names = [p.split(" ")[0] for p in made.split(", ")]
    types = [TYPES[p.split(" ")[1]][1] for p in made.split(", ")]
    return df.select(*dict.fromkeys([*keep, *use])).mapInArrow(run, schema)


def with_totals(rows: DataFrame, totals: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row for each ``key``, null included); no key's rows meet in one task.

    Each total is copied SALT times, and rows are dealt over the copies by ``spread``, a hash of other columns.
    """
    copies = totals.withColumnRenamed(key, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    dealt = rows.withColumn("_salt", F.pmod(spread, F.lit(SALT)))
    return dealt.join(copies, F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy"))).drop("_key", "_copy", "_salt")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt into ranges of ``order``, stored with the number of their range in ``_range``.

    Storing fixes the numbers; Spark's range bounds come from samples and would differ on a second run.
    """
    return stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def positions(df: DataFrame, order: list[Column], weight: str | None = None) -> DataFrame:
    """Add ``position``: the number (or with ``weight`` the summed weight) of all rows before this one, and ``total``.

    ``order`` must end in a column that tells rows apart, unless equal rows are interchangeable. Windows run inside
    ranges of about equal size; only one row for each range is summed globally.
    """
    parts = ranged(df, *order)
    amount = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    sums = parts.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                         F.sum("_sum").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_inside", inside).join(before, "_range").withColumn("position", F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")
