"""Shared helpers: scratch tables in the cluster's shared folder, and vectorised word hashing.

Scratch tables cut lineage.  They go to the folder named by ``spark.checkpoint.dir``, which
every executor can reach, so a lost executor costs a re-read and never the job.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: ASCII white space of the word contracts, as a Java / RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of our own, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _local_scratch[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, with its lineage cut."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


class Scratch:
    """The scratch tables of one call: each is deleted after its last reader, ``drop()`` deletes those that are left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, form: str = "parquet") -> DataFrame:
        path = f"{scratch_root(self.spark)}/{self.name}-{name}-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.format(form).option("compression", "zstd").save(path)
        out = self.spark.read.format(form).schema(schema).load(path)
        self.paths[id(out)] = out, path
        release(self.spark)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Not to be deleted: what the caller's result reads."""
        self.paths.pop(id(df), None)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for key in [id(t) for t in tables] or list(self.paths):
            if key in self.paths:
                at = jvm.org.apache.hadoop.fs.Path(self.paths.pop(key)[1])
                at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow; what a task has freed by its end goes back to the system.

    Python workers outlive their tasks and would keep it beside the JVM of the stages that follow.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(source)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library alone
            trim(0)

    return batches


def add_columns(docs: DataFrame, text: str, fields: list[tuple[str, str]], work: Callable[[pa.Array], Iterator[list[pa.Array]]]) -> DataFrame:
    """Each row with the columns ``fields`` that ``work`` gives for runs of its text column, in order.

    Columns travel under names of our own, so the caller's may be any; one of ``fields`` that exists already is replaced.
    """
    new = [n for n, _ in fields]
    inner = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    kept = [i for i, c in enumerate(docs.columns) if c not in new]
    at = f"in_{docs.columns.index(text)}"
    names = [f"in_{i}" for i in kept] + [f"out_{i}" for i in range(len(fields))]
    schema = StructType([StructField(f"in_{i}", docs.schema[i].dataType) for i in kept] + [StructField(f"out_{i}", _parse_datatype_string(t)) for i, (_, t) in enumerate(fields)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            columns, begin = [batch.column(batch.schema.get_field_index(f"in_{i}")) for i in kept], 0
            for got in work(batch.column(batch.schema.get_field_index(at))):
                yield pa.RecordBatch.from_arrays([c.slice(begin, len(got[0])) for c in columns] + got, names)
                begin += len(got[0])

    return inner.mapInArrow(tidy(batches), schema).toDF(*[docs.columns[i] for i in kept], *new)


# --- vectorised words -------------------------------------------------------------------------

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits; its multipliers are fixed values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes handled at once: bounds the temporary arrays whatever the length of a text.
CHUNK = 1 << 20
_SEEDS = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base, and of its inverse, modulo 2**64."""
    if not _POW or len(_POW[0]) < n:
        _POW[:] = [_powers(_BASE, max(n, CHUNK + 1)), _powers(_INVERSE, max(n, CHUNK + 1))]
    return _POW[0], _POW[1]


def byte_table(spaces: bytes) -> np.ndarray:
    """is_word[256]: all bytes but ``spaces``."""
    t = np.ones(256, dtype=bool)
    t[np.frombuffer(spaces, dtype=np.uint8)] = False
    return t


WHITE = byte_table(b" \t\n\x0b\x0c\r")
#: A-Z to a-z over bytes; UTF-8 bytes above 0x7F stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts.

    data: the texts' bytes one after another; bounds: their n+1 offsets.  Returns the hashes in
    order and, for each text, the offset of its first word (n+1 values).  Works chunk by chunk,
    cut where no word is open, so temporaries stay small for texts of any length.
    """
    out, at_all = [], []
    n, at = len(data), 0
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:
            stop = end
            while stop > at:  # back to a byte that is no word byte, looked for in growing steps
                lo = max(at, stop - 4096)
                gaps = np.flatnonzero(~is_word[data[lo:stop]])
                if len(gaps):
                    end = lo + int(gaps[-1]) + 1
                    break
                stop = lo
            else:  # one word longer than a chunk: take all of it
                end = at
                while end < n and bool(is_word[data[end : end + CHUNK]].all()):
                    end = min(n, end + CHUNK)
                if end < n:
                    end += int(np.argmin(is_word[data[end : end + CHUNK]])) + 1
        piece = data[at:end]
        mask = is_word[piece]
        first = mask.copy()
        first[1:] &= ~mask[:-1]
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
        cuts = cuts[(cuts >= 0) & (cuts < len(piece))]
        first[cuts] |= mask[cuts]
        inner = cuts[cuts > 0]
        last[inner - 1] |= mask[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_SEEDS[piece] * power[: len(piece)], dtype=np.uint64, out=sums[1:])
        h = (sums[e] - sums[s]) * inverse[s]
        out.append(mix64(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        at_all.append(s + at)
        at = end
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    starts = np.concatenate(at_all)
    return np.concatenate(out), np.searchsorted(starts, bounds).astype(np.int64)


def text_slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of runs of texts of about ``most`` bytes; null reads as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, body = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(off, off[a] + most, side="right")) - 1
        b = min(max(b, a + 1), len(column))
        yield a, b, body[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
