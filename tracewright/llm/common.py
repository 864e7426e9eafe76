"""Helpers shared by the training-data operators: the shared scratch folder, folds and text normalisation."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators' contracts define it.
SPACE = r"[\x20\x09-\x0D]+"


_held: dict[tuple, object] = {}


def held(owner: str, key: object, make: Callable[[], object]):
    """make(), kept in this Python worker for the operator owner.

    Spark reuses workers from stage to stage: what other operators have kept is let go first, so a worker holds the
    tables of one operator at a time, however many stages it has served.
    """
    if any(k[0] != owner for k in _held):
        _held.clear()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)
    if (owner, key) not in _held:
        _held[owner, key] = make()
    return _held[owner, key]


class Recent:
    """Values by key, at most twice ``size``: when the young ones are that many they become the old ones, which go when
    the next do. What is asked for again moves to the young, so frequent keys stay."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def find(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.young[key] = value
        return value

    def turn(self) -> None:
        """To be called between texts: nothing is dropped within one."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the session names none, a temporary one, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tracewright-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables that one run writes to the shared folder, deleted together when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.written = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.written += 1
        path = f"{self.path}/{self.written}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 500, size: str = "8m") -> DataFrame:
    """df, after bounding the rows and bytes of an Arrow batch: texts can be long, and a task holds several batches at once."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends at files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a map of keys for each key, in a row, and at most (8 MB; a fuller map marks more rows, never fewer).
KEY_BITS, ROW_BITS, MOST_KEY_BITS = 16, 1 << 15, 1 << 26


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with a boolean ``hit``: true where keys has the row's key (null is one), and seldom elsewhere.

    What isn't hit needs no join with keys, so rows with long texts needn't be shuffled to learn that. The keys' bits are
    broadcast, at most 8 MB of them. keys is read twice.
    """
    bits = min(MOST_KEY_BITS, max(ROW_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(bits)) + 1
    at = F.bitmap_bit_position(slot).cast("int")
    held = keys.groupBy(F.bitmap_bucket_number(slot).alias("__row")).agg(F.bitmap_construct_agg(at.cast("bigint")).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__row", F.bitmap_bucket_number(slot)).join(F.broadcast(held), "__row", "left")
    return found.withColumn("hit", F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop("__row", "__bits")


def beside(df: DataFrame, *added: str) -> DataFrame:
    """The fields of df's struct ``row`` and the columns added; an added column takes the place of a field of its name."""
    taken = {a.lower() for a in added}
    fields = [f.name for f in df.schema["row"].dataType.fields if f.name.lower() not in taken]
    return df.select(*(F.col("row").getField(f).alias(f) for f in fields), *added)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets; a null key counts as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
