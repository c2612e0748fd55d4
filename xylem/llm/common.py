"""What the corpus operators share: staging tables, word splitting and packed arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    It is set here only where it is unset and everything runs in one process, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="xylem-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: How tables of hashes and other values that hardly recur are written: without a dictionary, which would be made in vain.
PLAIN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}


class Staging:
    """Tables of one run in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.dealt: dict[str, str] = {}

    @classmethod
    def at(cls, spark: SparkSession, root: str) -> Staging:
        """Tables under a given folder."""
        made = cls.__new__(cls)
        made.spark, made.root, made.dealt = spark, root.rstrip("/"), {}
        return made

    def save(self, df: DataFrame, name: str, batch_rows: int | None = None, plain: bool = False) -> DataFrame:
        """df as a table that was written and is read again. batch_rows: how many rows reach Python at once, where rows are long.
        plain: that values hardly recur."""
        with self._batches(batch_rows):
            df.write.mode("overwrite").options(**PLAIN if plain else {"compression": "zstd"}).parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def deal(self, df: DataFrame, name: str, key: str, batch_rows: int | None = None) -> DataFrame:
        """The same, dealt to buckets by a key, so that joins and groups by it do not shuffle the table again. A df that is
        partitioned by the key already is not shuffled for it."""
        buckets, self.dealt[name] = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"xylem_{uuid.uuid4().hex[:16]}"
        with self._batches(batch_rows):
            writer = df.write.format("parquet").option("path", f"{self.root}/{name}").option("compression", "zstd")
            writer.bucketBy(buckets, key).sortBy(key).saveAsTable(self.dealt[name])
        return self.spark.table(self.dealt[name])

    @contextmanager
    def _batches(self, rows: int | None) -> Iterator[None]:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        try:
            self.spark.conf.set(key, rows or before)
            yield
        finally:
            self.spark.conf.set(key, before)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str, like: DataFrame | str) -> DataFrame:
        """like: a DataFrame with the table's columns, or their schema."""
        return self.spark.read.schema(like if isinstance(like, str) else like.schema).parquet(f"{self.root}/{name}")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads."""
        if name in self.dealt:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.dealt.pop(name)}")
        path, system = self._path(name)
        system.delete(path, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        """A run that fails leaves nothing behind either."""
        self.close()

    def close(self) -> None:
        """Removes all tables."""
        for name in list(self.dealt):
            self.drop(name)
        self.drop("")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, natively; an array without elements for null and blank texts."""
    spaced = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null texts are empty ones."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


#: Classes of hashes that tell rows which may join from rows which cannot; so many numbers are broadcast at most.
CLASSES = 1 << 21


def parted(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among the ids (a table with one column), and rows whose key is not. The first are few while the ids
    are few against CLASSES, and then a join with the ids shuffles little."""
    of = lambda x: F.pmod(F.xxhash64(x), F.lit(CLASSES)).cast("int")
    classes = F.broadcast(ids.select(of(F.col(ids.columns[0])).alias("__class")).distinct())
    marked = rows.withColumn("__class", of(key))
    return marked.join(classes, "__class", "left_semi").drop("__class"), marked.join(classes, "__class", "left_anti").drop("__class")


def told_apart(docs: DataFrame, decided: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows of docs with what is decided of them, and rows of which nothing is. decided: doc_id, digest (of the text) and more columns,
    each id and digest once. The first have docs' columns and __id, __digest and the further columns of decided, null in rows that
    were looked at in vain."""
    mark = lambda name, digest: F.xxhash64(name, digest)
    keyed = docs.withColumns({"__id": F.col(key).cast("long"), "__digest": text_key(F.col(text))})
    some, others = parted(keyed, mark("__id", "__digest"), decided.select(mark("doc_id", "digest").alias("mark")))
    more = decided.withColumnsRenamed({"doc_id": "__of", "digest": "__text"})
    # decided may grow with docs, so it is not broadcast at any size
    return some.join(more.hint("merge"), F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__digest") == F.col("__text")), "left"), others.select(*docs.columns)


def byte_words(text: str | None) -> list[bytes]:
    """The same words as UTF-8: bytes.split() knows no white space but ASCII's."""
    return text.encode().split() if text else []


#: Bytes A-Z to a-z, all others kept.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = b"".join(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays that pack() was given, with their kinds."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(planes) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: each bit of the result hangs on all bits of x."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


class Cache(dict):
    """make(key) of keys met so far. A full cache starts anew, so that frequent keys are soon back; long keys never enter."""

    def __init__(self, make, entries: int = 1 << 18, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest = make, entries, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value
