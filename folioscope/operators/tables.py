"""Intermediate tables, and Python functions of single values."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tasks_for(rows: DataFrame, most: int) -> int:
    """How many tasks to deal ``rows`` to, so that one has about ``most`` of them however many there are. They are counted, so they should be cheap to read."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def dealt(df: DataFrame, most: int = 250_000) -> DataFrame:
    """``df`` dealt by ``doc_id`` to tasks of about ``most`` rows however many there are, so that what sorts a document's rows needs no more memory for more documents."""
    return df.repartition(tasks_for(df, most), "doc_id")


def written(df: DataFrame, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read again, so that what is built on it is planned on its own and does not recompute it.

    Given ``tasks``, it is written in so many buckets by ``doc_id``. Aggregates and windows of such tables by keys with the document, and joins
    by the document alone, then shuffle nothing. Rows that are ``dealt`` so already are not shuffled for it.

    Only a session without a cluster may leave that folder unset, and gets a local one."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where}/tables/{uuid.uuid4().hex}"
    if tasks is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"folioscope_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(tasks, "doc_id")).write.format("parquet").bucketBy(tasks, "doc_id").option("path", path).saveAsTable(name)
    return spark.table(name)


def by_row(change: Callable, returns: str) -> Callable[..., Column]:
    """``change`` as a column function. A worker holds a hundred rows at a time, where Arrow's batches hold thousands of documents, however long.

    It is made when it is called, for types need a session, and says of itself that it is not deterministic, so that a filter of its result does
    not evaluate it again."""
    return lambda *columns: F.udf(change, returns, useArrow=False).asNondeterministic()(*columns)
