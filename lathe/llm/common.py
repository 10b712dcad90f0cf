"""What the operators of this package share: reading, staging between phases, flat word and byte arrays."""

from __future__ import annotations

import gc
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.plans.folders import shared_folder

#: Stands for a null doc_id inside the operators; it sorts before all others.
NULL_ID = -(2**63)


#: Paths of staged tables, by the DataFrame.
STAGED: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_limits(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def staged(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and lost executors cost nothing before it. rows: the most in
    a file, for large rows, as readers and writers hold many of a file's rows at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    STAGED[id(out)] = path
    return out


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(table: DataFrame) -> None:
    """Removes a staged table that nothing reads any more; the others go when the driver's JVM ends."""
    path = STAGED.pop(id(table), None)
    if path:
        files, at = file_system(table.sparkSession, path)
        files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of phases that have been staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32(doc_id: int | None) -> int:
    """crc32 of doc_id as decimal text; null counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_mod(column, n: int):
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def split_words(column: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of all texts, the number of each word in order, and where each text's words begin, and the end. Words are
    apart by ASCII white space; lower: with A-Z lower-cased. Null texts have none."""
    if column.offset:  # the kernels below misread slices
        column = column.take(pa.array(np.arange(len(column))))
    text = pc.fill_null(column.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at the ends of a text gives empty words
        flat = flat.filter(pa.array(full))
        offsets = np.append(0, np.cumsum(full))[offsets]
    found = flat.dictionary_encode()
    return found.dictionary.cast(pa.large_binary()).to_pylist(), found.indices.to_numpy().astype(np.int64), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def record_batches(columns: dict[str, tuple], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from {name: (values, type)}."""
    arrays = {k: pa.array(v, t) for k, (v, t) in columns.items()}
    whole = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
    for at in range(0, whole.num_rows, size):
        yield whole.slice(at, size)


def rewritten(docs: DataFrame, make_decide, spans: DataFrame | None = None) -> DataFrame:
    """docs, all its columns, less rejected rows and with new texts. make_decide() gives, in each task, a function of the texts (and
    their spans, if spans(doc, row, spans) is given) that returns for each its new text, or None to reject it. A null text is
    judged as an empty one, and stays null if it is kept. n_chars follows the text where it changes."""
    schema, names = docs.schema, docs.columns
    at = names.index("text")
    spanned = spans is not None
    # What a column is called inside does not matter: they are taken by place.
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    if spanned:
        inner = inner.withColumns({"doc": F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(NULL_ID)), "row": F.xxhash64(f"c{at}")})
        inner = inner.join(spans.select("doc", "row", "spans"), ["doc", "row"], "left").select(*[f"c{i}" for i in range(len(names))], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make_decide()
        for b in batches:
            old = b.column(at)
            raw = texts(old)
            new = decide(raw, b.column(len(names)).to_pylist()) if spanned else decide(raw)
            keep = pa.array([x is not None for x in new], pa.bool_())
            cols = [b.column(i) for i in range(len(names))]
            if not all(x is None or x is y for x, y in zip(new, raw, strict=True)):
                null = old.is_null().to_pylist()
                text = [None if x is None or (n and not x) else x for x, n in zip(new, null, strict=True)]
                cols[at] = pa.array(text, pa.binary()).cast(pa.string()).cast(old.type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    chars = [len(x.decode("utf-8", "replace")) if x is not None and x is not y else n for x, y, n in zip(new, raw, cols[k].to_pylist(), strict=True)]
                    cols[k] = pa.array(chars, cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    return inner.mapInArrow(run, schema)
