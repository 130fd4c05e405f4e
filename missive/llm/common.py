"""What several operators share: shared-folder tables, shipping of this package, ASCII word splitting and word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; the same that bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"{tempfile.gettempdir()}/missive-{spark.sparkContext.applicationId}"
    os.makedirs(found, exist_ok=True)
    return f"file://{found}"


#: Folders of stored tables that are not deleted yet, by the frames that read them and in the order of writing.
_folders: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """df written to the shared folder in n buckets by key: tasks that group it by key need no exchange. To be given to ``drop``, too."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    _folders[path] = spark
    return _bucketed_at(spark, path, name)


def _bucketed_at(spark: SparkSession, path: str, name: str) -> DataFrame:
    out = spark.table(name)
    out._stored_at, out._table = path, name
    return out


def appended(table: DataFrame, df: DataFrame, key: str, n: int) -> DataFrame:
    """A table of ``bucketed`` (key and n as there) with the rows of df, too."""
    df.write.mode("append").option("path", table._stored_at).bucketBy(n, key).sortBy(key).saveAsTable(table._table)
    return _bucketed_at(df.sparkSession, table._stored_at, table._table)


def _delete(paths: list[str]) -> None:
    for path in paths:
        if (spark := _folders.pop(path, None)) is not None:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables; nothing that is still to be computed may read them."""
    for t in tables:
        if getattr(t, "_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._table}")
    _delete([t._stored_at for t in tables if getattr(t, "_stored_at", None)])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referred to: it does so when the driver's JVM collects them.

    First Python lets go of them, then the gateway between both, then the JVM itself.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def keeping(table: DataFrame, before: set[str]) -> DataFrame:
    """table, a stored one; all that was stored since ``before`` but for it is deleted."""
    _delete([p for p in _folders if p not in before and p != table._stored_at])
    return table


def folders() -> set[str]:
    """The stored tables there are, for ``keeping``."""
    return set(_folders)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()) / "missive_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):  # all of it, as it comes before any other copy
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def own_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, case ignored as Spark does."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_remembered: dict[str, object] = {}


def trimmed_worker() -> None:
    """Gives what ended work left in this Python worker back to the system: a worker serves stage after stage, and would keep the most that any took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def remembered(what: str, make: Callable[[], object]):
    """What make() made in this Python worker, kept from task to task. What another operator kept is forgotten first, so that a worker holds one such memory."""
    if what not in _remembered:
        if _remembered:
            fresh_worker()
        _remembered[what] = make()
    return _remembered[what]


def fresh_worker() -> None:
    """Forgets what any operator keeps in this Python worker: for tasks that keep nothing, but need room."""
    _remembered.clear()
    gc.collect()
    trimmed_worker()


#: Multiplier of the polynomial window hash (odd, so that no bits are lost).
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive entries of h; empty if h is shorter."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _STEP
        out += h[k : k + m]
    return mixed(out)


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (np.unique goes by a hash table, which is many times slower on such arrays)."""
    a = np.sort(a)
    return a[_new(a)]


def _new(a: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return new


def grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (uint64 below 2**bits), the first place of each, and the number of each key's: by a sort of keys with their places."""
    b = max(1, (len(keys) - 1).bit_length())
    if not len(keys):
        return keys, np.empty(0, np.int64), np.empty(0, np.int64)
    if bits + b > 64:  # halves take a bit less
        half, found, number = np.uint64(1 << bits - 1), [], np.empty(len(keys), np.int64)
        for at, low in ((np.flatnonzero(keys < half), np.uint64(0)), (np.flatnonzero(keys >= half), half)):
            every, firsts, numbers = grouped(keys[at] - low, bits - 1)
            number[at] = numbers + sum(len(x) for x, _ in found)
            found.append((every + low, at[firsts]))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), number
    code = np.sort(keys << np.uint64(b) | np.arange(len(keys), dtype=np.uint64))
    places = (code & np.uint64((1 << b) - 1)).astype(np.int64)
    code >>= np.uint64(b)
    new = _new(code)
    number = np.empty(len(keys), np.int64)
    number[places] = np.cumsum(new) - 1
    return code[new], places[new], number


def first_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The second result of ``grouped`` alone."""
    b = max(1, (len(keys) - 1).bit_length())
    if bits + b > 64 or not len(keys):
        return np.unique(keys, return_index=True)[1]
    code = np.sort(keys << np.uint64(b) | np.arange(len(keys), dtype=np.uint64))
    return (code[_new(code >> np.uint64(b))] & np.uint64((1 << b) - 1)).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x
