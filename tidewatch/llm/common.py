"""Helpers that the corpus operators share: shared folders, lineage cuts and text hashing."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes A-Z to a-z; every byte of a multi-byte character stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every other ASCII byte that is no digit or letter becomes a blank.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER_ALNUM).split()


def blank_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8; none for null."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach, under spark.checkpoint.dir.

    Where the session has no such setting, a local master (tests on one machine) gets a temporary folder, once for the session; on a
    cluster that is an error, since no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        base = jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
            base = jsc.getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Removes a query's shuffle files when it ends; what it has written does not need them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: lineage ends there, and the shuffles behind it go."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote and that nothing yet to be run reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: The session's bound on the bytes of a batch that goes to Python, and the most it is here: a worker holds several things made of a batch at once, and so does the JVM's side.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Sets the bound in the session, since plans read it when they run; a smaller one stays."""
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the executors, a batch of bounded size at a time."""
    ship(df.sparkSession)
    _bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Maps Arrow batches by the function that make() builds once in a task; None adds no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return arrow(df, run, schema)


def own_columns(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Of an operator that returns its first argument's columns: columns whose names begin with `__`, as its own do, are set apart meanwhile."""

    @functools.wraps(op)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names, mark = docs.columns, "own"
        while any(n.lower().startswith(mark) for n in names):
            mark += "_"
        apart = [f"{mark}{i}" if n.startswith("__") else n for i, n in enumerate(names)]
        return op(docs, *args, **options) if apart == names else op(docs.toDF(*apart), *args, **options).toDF(*names)

    return run


def seeded(*cols: str, seed: int = 0):
    """A 64-bit hash of the columns that samples and shuffles are ordered by."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = pow(self.BASE, -1, 1 << 64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            with np.errstate(over="ignore"):
                for name, base in (("up", self.BASE), ("down", self.inverse)):
                    p = np.full(size, base, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `width` words (of all its words where there are fewer).

    A run's hash is a polynomial over the bytes of its words joined by one blank, so the whole text takes one pass.
    """
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(ends))
    first, last = starts[: len(starts) - k + 1], ends[k - 1 :]
    # the length takes part, so that a run never equals a shifted one with other bounds
    return np.unique(mixed((sums[last] - sums[first]) * down[first] + mixed((last - first).astype(np.uint64))))
