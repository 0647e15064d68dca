"""What the operators of this subpackage share: rows, shared folder, batches, word spans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes that separate words: space and \t \n \v \f \r.
SPACE = "\x20\x09-\x0d"
#: The same set in Java's regex syntax.
JAVA_SPACE = "[\\x20\\x09-\\x0D]"

#: Texts that one step of a Python task holds at a time: rows and characters.
STEP_ROWS, STEP_CHARS = 512, 4_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text alone: whatever other columns the table has can't clash."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that settle() wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("barloom-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with their texts as str, of a bounded size save for a single long text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > STEP_CHARS or i - start >= STEP_ROWS):
                yield batch.slice(start, i - start), col.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += n
        if len(sizes) > start:
            yield batch.slice(start), col.slice(start).to_pylist()


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch, list], dict]], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over steps(): make() builds a function of (rows, texts) once a task, which gives columns by name."""
    added = T.StructType.fromDDL(schema)
    names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for rows, words in steps(batches):
            got = f(rows, words)
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), *(got[c] for c in names)], names=[*keep, *names])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *added.fields]))


def array_of(rows: list, kind: pa.DataType) -> pa.Array:
    """A list array from numpy arrays or lists, one per row."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, kind.to_pandas_dtype()) for r in rows]) if rows and offsets[-1] else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


_hash = xxhash.xxh3_64_intdigest


class WordHashes(dict):
    """64-bit hash of a word; remembers words until it holds many, then starts anew."""

    MOST = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = _hash(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers that mix the positions of a window; fixed so that every task agrees.
_MIX = np.random.default_rng(20240501).integers(1, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n units; empty if there are fewer."""
    m = len(units) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += (units[k : k + m] ^ (units[k : k + m] >> np.uint64(29))) * _MIX[k]
    return scramble(total)


def words_of(text: str | None) -> list[str]:
    """Words of [^\\x20\\x09-\\x0D]+."""
    if not text:
        return []
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_ascii(text: str) -> str:
    """A-Z to lower case, all else as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words_column(text: F.Column) -> F.Column:
    """array<string> of the words of a text, JVM-side; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), JAVA_SPACE + "+"), lambda w: w != "")
