"""Helpers that the text operators share: reading, cutting lineage, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that one Arrow batch may hold, so that a worker's memory does not grow with the table.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000
#: Bits of a table that says which ids a scan has to look at.
FILTER_BITS = 1 << 24
#: A key is joined by broadcast where at least one row in so many has it.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session without a cluster may leave it unset, and gets a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialised(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet, with the writer's ``options``, and read again.

    Later readers neither recompute it nor depend on an executor's disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_spread(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table that has one row a key and, in ``weight``, how many of ``rows`` have it.

    Keys with a ``HOT``-th or more of all rows, of which there can be no more than ``HOT``, are broadcast and their rows stay where
    they are; so no task has to take more than a ``HOT``-th of the rows for one key. Keys must not be null."""
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT >= total
    often = F.broadcast(keyed.where(hot))  # at most HOT rows
    near = rows.join(often, keys)
    return near.unionByName(rows.join(often.select(*keys), keys, "left_anti").join(keyed.where(~hot), keys))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null: empty); all others are left out, so their names cannot clash."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def ids_are_unique(df: DataFrame) -> bool:
    """Whether no ``doc_id`` is null or stands in several rows."""
    return df.groupBy("doc_id").agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty()


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row``, a number of each row, written so that rows keep theirs."""
    return materialised(df.withColumn("row", F.monotonically_increasing_id()))


#: For each module whose workers remember something from task to task, how they forget it.
_FORGET: dict[str, Callable[[], None]] = {}


def remembers(module: str, forget: Callable[[], None]) -> None:
    _FORGET[module] = forget


def keep_only(module: str) -> None:
    """Empty what this worker has remembered for other modules, so that stages that follow one another do not add up."""
    for name, forget in _FORGET.items():
        if name != module:
            forget()


class KnownLists:
    """Lists of integers that strings stand for. They lie in Arrow arrays, which take a fraction of what a dict of as many strings does.

    When they take more than ``most`` bytes, only those of the last batch are kept, or none if even these take more."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.strings, self.lists = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def of(self, strings: pa.Array, make: Callable[[list[str]], pa.Array]) -> pa.Array:
        """The lists of ``strings``, which are distinct; ``make`` gives those of the ones that are not known."""
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(at.is_null())
        if not len(new):
            return self.lists.take(at)
        places, unknown = at.fill_null(0).to_numpy().copy(), at.is_null().to_numpy(zero_copy_only=False)
        places[unknown] = range(len(self.strings), len(self.strings) + len(new))
        self.strings, self.lists = pa.concat_arrays([self.strings, new]), pa.concat_arrays([self.lists, make(new.to_pylist())])
        found = self.lists.take(pa.array(places))
        if self.strings.nbytes + self.lists.nbytes > self.most:
            self.strings, self.lists = strings, found
            if strings.nbytes + found.nbytes > self.most:
                self.clear()
        return found


def set_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """Apply ``work`` (a record batch in, a dict of columns out) to every batch of ``df``."""
    spark = df.sparkSession
    set_batches(spark)
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(work.__module__)
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                made = pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
                del batch, out
                yield made
                del made
                pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def bit_table(places: DataFrame, bits: int = FILTER_BITS):
    """Words of 64 bits, of which those at the places ``p`` are set."""
    import numpy as np

    words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for row in words.collect():  # at most bits / 64 rows
        table[row["w"]] = row["b"]
    return table


def bit_words(places: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One written row of ``words``, an array of ``bits / 64`` numbers, in which the bits at the places ``p`` are set."""
    words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = places.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    pairs = F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b"))))  # bits / 64 of them
    return materialised(every.agg(F.transform(pairs, lambda x: x["b"]).alias("words")))


def bit_is_set(words: DataFrame, place: Column) -> Column:
    """Whether the bit at ``place`` is set in the row that ``bit_words`` has written, which is read once for each task's plan."""
    word = F.element_at(words.scalar(), (F.floor(place / 64) + 1).cast("int"))
    return F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1


def id_filter(ids: DataFrame, id_col: str, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test for ids of a scan, in Spark's own functions: true for all of ``ids`` and, the fuller the table of bits, for some others.

    The table has a fixed number of bits, so what each task is sent does not grow; a full one only filters less. Null is false."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = bit_words(ids.select(place(F.col(id_col)).alias("p")), bits)
    return lambda column: column.isNotNull() & bit_is_set(words, place(column))


def without_ids(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``df`` without the rows whose id is among ``gone`` (``__id``); rows of no id stay.

    Only rows that the bits of ``gone`` let through take part in the join; the others are not shuffled."""
    gone = materialised(gone)
    own = df[id_col].cast("long")
    maybe = id_filter(gone, "__id")(own)
    asked = df.where(maybe)
    return df.where(~maybe).unionByName(asked.join(gone, asked[id_col].cast("long") == gone["__id"], "left_anti"))


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def list_array(parts: list, kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array a row, without Python objects for the elements."""
    import numpy as np

    ends = np.cumsum([0, *(len(p) for p in parts)], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, type=kind))
