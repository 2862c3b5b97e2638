"""What the operators share: the cluster's shared folder, shipping of code, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the vectorised code; a longer document is a step of its own.
STEP_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Folders that are to go at the end.
_cleaned: set[str] = set()
#: The columns of the documents table, which the pipeline's stages keep.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_leafmill_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="leafmill-")) / "leafmill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(str(out))
    context._leafmill_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own is set only where that is unset, as in local tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="leafmill-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's own part of the shared folder, which goes when the driver's process ends."""
    own = f"{shared_folder(spark).rstrip('/')}/leafmill-{spark.sparkContext.applicationId}"
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_clean, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own), spark.sparkContext._jsc.hadoopConfiguration())
    return f"{own}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"


def _clean(path, conf) -> None:
    try:
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, no lineage, safe from lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def whole(docs: DataFrame) -> Column:
    """A struct of all columns, to carry a row beside columns of one's own: no name can clash."""
    return F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns])


def unpacked(df: DataFrame, columns: list[str], name: str = "d") -> DataFrame:
    """The columns of the struct that whole() made."""
    return df.select(*[F.col(f"{name}.{quoted(c)}").alias(c) for c in columns])


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def remainder(df: DataFrame, n: int):
    """crc32 of doc_id as text, modulo n; of the empty text where doc_id is null."""
    return F.crc32(F.coalesce(df["doc_id"].cast("string"), F.lit("")).cast("binary")) % n


def tidy() -> None:
    """At the end of a task: give memory that is free back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


# Words and hashes over Arrow buffers ---------------------------------------


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def byte_classes(separators: bytes, lower: bool) -> np.ndarray:
    """A table of bytes to themselves, lower-cased if asked for, and separators to 0."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Blank-separated words as they are, without a change of case.
CASED = byte_classes(SPACES, lower=False)
CASED[0] = 255
#: Words of [^\x20\x09-\x0D], and of letters, digits and all beyond ASCII.
BLANK = byte_classes(SPACES, lower=True)
ALNUM = byte_classes(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)), lower=True)
#: NUL is a character of words of the first kind but 0 is the mark of separators.
BLANK[0] = 255

_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
GRAM = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        found = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            found.append(np.multiply.accumulate(x))
        if n > 8 * STEP_BYTES:
            return found  # not kept: one very long text
        _powers[:] = found
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (n + 1)."""
    is_word = table[data] != 0
    first = np.zeros(len(data) + 1, bool)
    first[offs[:-1]] = True
    first = first[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (first | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:] & ~first[1:]
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's mapped bytes; the same in every process."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[table[data]] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GRAM[63])


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on that has so many."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - n + 1] * GRAM[0]
    for j in range(1, n):
        total = total + h[j : len(h) - n + 1 + j] * GRAM[j]
    return mix(total)


def hashed_steps(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first, last + 1, the hashes of their words, and the number of words before each row."""
    data, offs = buffers(column)
    for lo, hi in steps(offs):
        part, own = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        starts, ends, before = words(part, own, table)
        yield lo, hi, word_hashes(part, starts, ends, table), before


def texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def local_package() -> str:
    """For tests: the folder that has this package."""
    return os.fspath(Path(__file__).resolve().parents[2])
