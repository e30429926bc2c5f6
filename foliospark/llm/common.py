"""What the training-data operators share: tables in the shared folder, name hygiene, ASCII folding."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import shared_dir

#: White space of every text contract here: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_open: list[list[str]] = []  # what the calls of passing() that now run have written


def drop_table(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        files.deleteOnExit(target)
    else:
        files.delete(target, True)


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again.

    It cuts the lineage, survives the loss of executors, and gives the planner a true size, so that a
    join with it is broadcast only when that size is under spark.sql.autoBroadcastJoinThreshold.
    The table goes when the driver's JVM ends, or when passing() does. small: it holds a small part of what it was made from,
    so its rows are dealt to an eighth of the shuffle's tasks, and as many files fewer; what makes them keeps all its tasks.
    """
    spark = df.sparkSession
    if small:
        df = df.repartition(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/foliospark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_table(spark, path, at_exit=True)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def passing(name: str):
    """The decorated function's result is written as a table of this name, and the tables it was made from are dropped."""

    def around(make):
        @functools.wraps(make)
        def run(*args, **options) -> DataFrame:
            _open.append([])
            try:
                out = make(*args, **options)
                spark, paths = out.sparkSession, list(_open[-1])
                done = written(out, name)
            finally:
                made = _open.pop()
            for path in paths:
                drop_table(spark, path)
            if _open:
                _open[-1] += [x for x in made if x not in paths]
            return done

        return run

    return around


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not have yet (in any letter case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. A string of ASCII alone takes the fast path of lower()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*cols: Column) -> tuple[Column, Column]:
    """128 bits that stand for the values of a row; equal rows share them. Never null."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


SLOT_BITS = 20


def slots_of(keys: DataFrame, slot: Callable[[int], Column]) -> tuple[DataFrame, Column]:
    """The slots that the keys fill, to be broadcast: 2**SLOT_BITS rows of 8 bytes at most, 16 for a key when these are fewer.

    slot: the slot of a row in a table of that many bits. Rows whose slot none of the keys fills have none of the
    keys, so that only the others need a shuffle to meet them.
    """
    bits = max(8, min(SLOT_BITS, (keys.count() * 16).bit_length()))
    return F.broadcast(keys.select(slot(bits).alias("_slot")).distinct()), slot(bits)
