"""What the operators of this package share: reading tables, word rules, intermediate tables and joins of bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words are runs of anything but these six white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

SENT = 16 << 20  # bytes that a join sends to every task at most
FEW = 1 << 20  # the same where the other side has no texts and both grow with the corpus, so plans don't change with its size
HUB = 1000  # rows of a key below which it is never set apart
BITS = 27  # a bitmap of keys has 2 to the power of this many bits, 16 MB, at every size

_own_folder: list[str] = []
_scopes: list[list] = [[]]  # tables that written() made, by the temporary() they were made in; the first is the process


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or in local mode a temporary folder of this process."""
    if given := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return given.rstrip("/")
    if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sightline-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, and readable after an executor is lost.

    It is deleted when the temporary() around it ends (outer: the one around that), by dropped(), or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    _scopes[max(0, len(_scopes) - 1 - outer)].append((path, system, folder))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _deleted(tables: list) -> None:
    for _, system, folder in tables:
        with contextlib.suppress(Exception):  # the session may have ended
            system.delete(folder, True)
    tables.clear()


atexit.register(lambda: [_deleted(scope) for scope in _scopes])


@contextlib.contextmanager
def temporary():
    """Tables that written() makes inside are deleted at the end, whoever made them; only for work whose results are written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        _deleted(_scopes.pop())


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    for scope in _scopes:
        for held in [t for t in scope if t[0] == df._written_to]:
            scope.remove(held)
            _deleted([held])


def released() -> None:
    """Gives a Python worker's unused memory back, so that idle workers of earlier stages stay small."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """df.mapInArrow() in batches that long texts can't make large, with the worker's memory given back after each task."""
    small_batches(df.sparkSession)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(tidy, schema)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Lowers the session's limits on what goes to Python at once, where they are higher. They are read when a plan runs, so they stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def _bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row takes in a table that is sent to every task."""
    out = F.lit(32 + 8 * len(df.columns))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            out = out + 8 * F.coalesce(F.size(c), F.lit(0))
    return out.cast("long")


def _flagged(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """df with _maybe: false only where no row of other has its values of on, true for all others and, by chance, for some more.

    A bitmap of other's hashed keys is sent to every task, in rows of 512 bits; its size doesn't follow the tables'.
    """
    place = F.xxhash64(*on).bitwiseAND((1 << BITS) - 1)
    words = other.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("_m"))
    each = [F.max(F.when(F.col("_w").bitwiseAND(7) == k, F.col("_m"))).alias(f"_m{k}") for k in range(8)]
    bits = words.groupBy(F.shiftright("_w", 3).alias("_row")).agg(*each)
    found = df.withColumn("_p", place).withColumn("_row", F.shiftright("_p", 9)).join(F.broadcast(bits), "_row", "left")
    word = F.expr("CASE (_p >> 6) & 7 " + " ".join(f"WHEN {k} THEN _m{k}" for k in range(8)) + " END")
    bit = F.coalesce(F.expr("shiftright(_m, CAST(_p & 63 AS INT)) & 1L"), F.lit(0))
    return found.withColumn("_m", word).withColumn("_maybe", bit == 1).select(*df.columns, "_maybe")


def sifted(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose values of on other holds, and by chance a few more; nothing of df is shuffled."""
    return _flagged(df, other, on).filter("_maybe").drop("_maybe")


def only_in(df: DataFrame, wanted: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose values of on wanted holds, when df's values of on all lie in wanted or in others, and in one of them only.

    Exact without shuffling df: the few of others that the bitmap of wanted lets through are taken out by name.
    """
    clash = written(sifted(others.select(*on), wanted, on).distinct(), "clash")
    through = sifted(df, wanted, on)
    if (clash.agg(F.sum(_bytes_of(clash))).first()[0] or 0) <= SENT:
        return through.join(F.broadcast(clash), on, "left_anti")
    flagged = _flagged(through, clash, on)
    return flagged.filter("NOT _maybe").drop("_maybe").unionByName(flagged.filter("_maybe").drop("_maybe").join(clash, on, "left_anti"))


def joined(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: str | None = None, sent: int = SENT, at_most: int | None = None, *, sift: bool = False) -> DataFrame:
    """big join small (inner or left), small having one row for each key: sent to every task if it takes at most sent bytes, as
    measured, or as at_most, a proven bound on the rows of a small without texts or arrays, tells at once.

    Otherwise both are shuffled. rows names a column of small that tells how many rows of big have that key: keys with so
    many that only a bounded number can exist are sent to every task all the same, and only the others are shuffled,
    so no key's rows meet in one task. With sift, for a big of texts or one most of whose rows find nothing, rows that a bitmap of small's keys
    rules out aren't shuffled either. Every row of big comes out as a plain join would give it.
    """
    on = [on] if isinstance(on, str) else on
    if at_most is not None and at_most * (32 + 8 * len(small.columns)) <= sent:
        return big.join(F.broadcast(small), on, how)
    size = _bytes_of(small)
    found = small.agg(F.sum(size), F.max(size), *([F.sum(rows)] if rows else [])).first()
    if (found[0] or 0) <= sent:
        return big.join(F.broadcast(small), on, how)
    columns = [*on, *(c for c in big.columns if c not in on), *(c for c in small.columns if c not in on)]

    def shuffled(rest: DataFrame, other: DataFrame) -> DataFrame:
        if not sift:
            return rest.join(other, on, how).select(*columns)
        flagged = _flagged(rest, other, on)
        out = flagged.filter("_maybe").drop("_maybe").join(other, on, how).select(*columns)
        if how == "inner":
            return out
        missed = flagged.filter("NOT _maybe").select(*(F.col(c) if c in big.columns else F.lit(None).cast(small.schema[c].dataType).alias(c) for c in columns))
        return out.unionByName(missed)

    if not rows:
        return shuffled(big, small)
    hub = max(HUB, -(-int(found[2]) * int(found[1]) // max(1, sent)))  # at most found[2] / hub keys have more rows: they take at most sent bytes
    hubs = F.broadcast(small.filter(F.col(rows) > hub))
    rest = big.join(F.broadcast(small.filter(F.col(rows) > hub).select(*on)), on, "left_anti")
    return big.join(hubs, on).unionByName(shuffled(rest, small.filter(F.col(rows) <= hub)))


def one_each(keyed: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """The rows of keyed that stand for their class: of those with the ident at in classes (key, at, twins, many) one.

    With how left, rows of a class that isn't in classes are all kept. Only where a class has twins, rows with that ident too, are
    texts shuffled to drop the others, of which each task keeps one first.
    """
    rows = joined(keyed, classes, "key", how, rows="many", sift=True).filter("at IS NULL OR ident = at")
    if classes.filter("twins > 1").isEmpty():
        return rows
    return rows.filter("twins IS NULL OR twins = 1").unionByName(rows.filter("twins > 1").dropDuplicates(["key"]))


def folded(text: Column | str) -> Column:
    """Text with A-Z lower-cased and everything else untouched; null is empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def parts(total: float, each: float, least: int) -> int:
    """Number of parts of about the given size; grows with the data, never below least."""
    return max(least, -(-int(total) // int(each)))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], rows_per_part: int = 1_000_000) -> DataFrame:
    """df with place (1 for the first row in order) and, for each of sums, its sum over the rows before.

    Ranges of the order are summed apart and their sums added up, so no task holds more than a range; order must be total.
    """
    n = parts(df.count(), rows_per_part, 1)
    held = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "running")
    heads = held.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    heads = heads.select("_part", *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in ("n", *sums)))
    within = Window.partitionBy("_part").orderBy(*order)
    out = held.withColumn("_at", F.row_number().over(within))
    for k, c in sums.items():
        out = out.withColumn(f"_own_{k}", F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(heads), "_part")  # n rows
    return out.select(*df.columns, (F.col("_before_n") + F.col("_at")).alias("place"), *((F.col(f"_before_{k}") + F.col(f"_own_{k}")).alias(k) for k in sums))
