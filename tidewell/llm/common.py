"""Shared pieces of the text operators: word rule, shared-folder tables, column hygiene."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..sources.scratch import shared_folder

# Fixed value: the word rule of the contracts (ASCII digits and letters, and every non-ASCII character).
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold_table() -> bytes:
    table = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        if "A" <= c <= "Z":
            table[i] = i + 32
        elif not ("a" <= c <= "z" or "0" <= c <= "9"):
            table[i] = 32
    return bytes(table)


#: Rows of an Arrow batch at most.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bits of a Bloom filter that keeps most other rows out of a shuffle: for a key, and at most.
FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 26

#: Byte table: A-Z to lower case, every other ASCII non-word character to a space; UTF-8 bytes over 127 stay.
FOLD = _fold_table()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes, A-Z lower-cased. A null has none."""
    return utf8(text).translate(FOLD).split()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share. One is made up only in local mode, as in tests."""
    return shared_folder(spark)


def delete_tree(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete_tree(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by then; nothing depends on it
            pass

    atexit.register(clean)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it again: lineage ends there, on storage that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of an input can't clash with an operator's own."""
    return df.select(*columns)


def among(h: Column, keys: DataFrame) -> Column:
    """False for most hashes that aren't in the column h of keys, true for all that are: Spark's Bloom filter of fixed size."""
    n = keys.count()
    bits = min(max(n * FILTER_BITS, 1024), MOST_FILTER_BITS)
    bloom = keys.agg(InternalFunction._invoke_internal_function_over_columns("bloom_filter_agg", F.col("h"), F.lit(n).cast("long"), F.lit(bits).cast("long"))).scalar()
    sql = keys.sparkSession._jvm.org.apache.spark.sql
    own = sql.classic.ExpressionUtils
    return Column(own.column(sql.catalyst.expressions.BloomFilterMightContain(own.expression(bloom._jc), own.expression(h._jc))))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, whatever the session's own number: a row may be a long text, and a batch
    is held several times on its way to Python."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def map_rows(df: DataFrame, fn, schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow with a function from one RecordBatch, of `rows` rows at most, to any number of column dicts."""
    small_batches(df.sparkSession)
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in (whole.slice(a, rows) for whole in batches for a in range(0, whole.num_rows, rows)):
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """fn(pyarrow table of one group) -> column dict, for groups of bounded size: dealt by key, sorted, read in a stream."""
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held, last, out = [], None, {f.name: [] for f in target}  # batches of the group that is being read, its key, results

        def done():
            for name, values in fn(pa.concat_tables(held).combine_chunks() if len(held) > 1 else held[0]).items():
                out[name] += values

        def packed():
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
            for values in out.values():
                values.clear()
            return batch

        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not len(t):
                continue
            k = [t[c].to_numpy() for c in keys]
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1).tolist(), len(t)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(x[a] for x in k)
                if held and now != last:
                    done()
                    held = []
                held.append(t.slice(a, b - a))
                last = now
            if out[target.names[0]]:
                yield packed()
        if held:
            done()
            yield packed()

    small_batches(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


class Hashes(dict):
    """64-bit hash of each word seen, emptied when large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def held_out(mod: int, rest: int, doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves that remainder."""
    return F.coalesce((F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)) == F.lit(rest), F.lit(False))
