"""What the corpus operators share: table cuts in the shared folder, streaming of
bounded text chunks out of Arrow batches, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 text that one numpy step works on; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset
    and the session is a single process, as in tests, a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, so that
    later jobs neither repeat its lineage nor depend on any one executor. The table
    goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tallyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that cut() returned; nothing may read it later."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tallyloom-" in name:
            place = jvm.org.apache.hadoop.fs.Path(name)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished jobs before a large one begins."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, for the number of blocks or partitions."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def held(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in a string or binary column, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.zeros(n, np.int64)
    sizes[:] = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each row begins; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of UTF-8 rows, without a Python
    object per word: random values of the bytes, weighted by powers of an odd number,
    summed along the rows; a word's hash is a difference of two sums."""

    def __init__(self, lower: bool, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        self.base = 0x9E3779B97F4A7C15
        self.back = pow(self.base, -1, 1 << 64)
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        for name, x in (("up", self.base), ("down", self.back)):
            made = np.full(n, x, np.uint64)
            made[0] = 1
            setattr(self, name, np.multiply.accumulate(made))

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and for each row the index of its first word (one more at the end)."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
        if n + 1 > len(self.up):
            self._powers(max(n + 1, CHUNK_BYTES + 1))
        word = ~self.white[raw]
        begins = np.empty(n, bool)
        begins[0] = True
        np.logical_not(word[:-1], out=begins[1:])
        edges = at[at < n]
        begins[edges] = True
        begins &= word
        ends = np.empty(n, bool)
        ends[-1] = True
        np.logical_not(word[1:], out=ends[:-1])
        ends[edges[edges > 0] - 1] = True
        ends &= word
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[:n], out=sums[1:])
        h = mix((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))
        return h, np.searchsorted(first, at, "left")


def windows(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words that lie in one row, and the index of each one's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = np.uint64(0xD6E8FEB86659FD93)
    out = h[:n].copy()
    for j in range(1, k):
        out *= step
        out += h[j : j + n]
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.int32), np.diff(rows))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[at]), at


def pack_uints(x: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes each as the largest needs; the first byte says how many."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_uints(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view(np.uint64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising unsigned integers as differences: random hashes that share their first bits need a few bytes less."""
    x = np.ascontiguousarray(x, np.uint64)
    return pack_uints(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_uints(raw), dtype=np.uint64)


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(x):
        return []
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(first, [*first[1:], len(x)], strict=True))
