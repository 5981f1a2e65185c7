"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose executors are the driver, may lack it and gets a temporary folder;
    elsewhere that is an error, as what one machine keeps is lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='simplark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that lost executors never rerun what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` from a Parquet table in the shared folder: like ``cut``, in less room."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a checked broadcast may have; they are keys of at most some 50 bytes.
BROADCAST_ROWS = 300_000


def checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` materialised, and marked for broadcast if it has at most ``most`` rows; else joins shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def small(batches, text: int, rows: int = 500, size: int = 4 << 20):
    """The batches in parts of at most ``rows`` rows and ``size`` bytes of the column ``text``, or of one row.

    Spark bounds a batch by 64 MB and a row; what is made of texts is larger than they are.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for part in bounded(lengths, size, rows):
            yield batch.slice(part.start, part.stop - part.start)


def fresh(name: str, *taken: list[str]) -> str:
    """``name``, with underscores after it as long as a column has that name (in any case)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with c0, c1, ... for its column names: ``mapInArrow`` stumbles over dots and backticks in them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def without(docs: DataFrame, key: str, dropped: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` isn't in the ``column`` of ``dropped``; null keys stay. Any column names do."""
    gone = fresh("gone", docs.columns)
    return docs.join(checked(dropped.select(F.col(column).alias(gone)).distinct()), named(key) == F.col(gone), "left_anti")


#: Rows of one key that a join may deal to one task; keys with more are few enough to broadcast.
HOT_ROWS = 100_000


def join_keys(rows: DataFrame, found: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has each key once and in ``n`` how many of the rows have it; n leaves.

    Few keys are broadcast. Of more, those with over ``HOT_ROWS`` rows are, so none of them meets in a
    task; they are at most the rows over ``HOT_ROWS``.
    """
    found = cut(found)
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop(n)), keys, how)
    hot = F.broadcast(found.where(F.col(n) > HOT_ROWS).drop(n))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(found.where(F.col(n) <= HOT_ROWS).drop(n), keys, how)
    return rows.join(hot, keys).unionByName(rest)


def fold(key: Column, folds: int) -> Column:
    """The fold of a row: crc32 of the key as text, modulo ``folds`` (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def strings(column: pa.Array) -> list[str | None]:
    """The column as str; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        return [None if x is None else x.decode("utf-8", "replace") for x in raw]


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` followed by the columns of ``ddl``."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


_HELD: dict[object, object] = {}


def held_by_worker(key: object, make):
    """What ``make`` gives, kept in this Python worker for later tasks with the same key.

    Only one thing is kept: a worker serves one operator after another, and what the last one
    remembered goes back to the system.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # other C libraries have no such call
            pass
        _HELD[key] = make()
    return _HELD[key]


class Memo:
    """What words were encoded to, for the words met lately: two generations of at most ``most`` each.

    When the younger one is full it becomes the older one; words that are met again move back.
    """

    def __init__(self, most: int):
        self.most = most
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def covering(self, words: set[str], make) -> dict[str, bytes]:
        """A dictionary that has all ``words``; ``make`` gives those that weren't met."""
        missing = words.difference(self.now)
        if len(self.now) + len(missing) > self.most:
            self.old, self.now, missing = self.now, {}, words
        again = missing.intersection(self.old)
        self.now.update((w, self.old[w]) for w in again)
        self.now.update(make(list(missing.difference(again))))
        return self.now


def bounded(sizes: list[int], most: int, rows: int = 1 << 30):
    """Slices over at most ``rows`` consecutive rows whose sizes add up to ``most``, or over one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
