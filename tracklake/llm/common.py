"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tracklake.plans.materialize import materialize, shared_folder  # noqa: F401 - used by the operators

#: White space of the word rule of the operators: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(spark: SparkSession, ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


#: Bytes of one Arrow batch.  Texts differ in length by far, so a bound in bytes keeps Python workers small; the session's
#: own setting is used where it is smaller.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of Arrow batches to ``BATCH_BYTES``."""
    now = int(spark.conf.get(_BATCH_CONF).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict]] | Callable, ddl: str, start: Callable | None = None) -> DataFrame:
    """``mapInArrow`` for functions from one record batch to columns of values.

    ``work(batch, state)`` returns a dict of lists or arrays named as in ``ddl`` (or
    None); ``start()`` makes ``state`` once per task.
    """
    bound_batches(df.sparkSession)
    arrow = to_arrow_schema(schema_of(df.sparkSession, ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(batch, state)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, ddl)


def carry(docs: DataFrame, inputs: list[str], work: Callable, ddl: str, start: Callable | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """``map_batches`` over the columns ``inputs`` of ``docs`` that carries all its columns along.

    Returns the frame and, for each column of ``docs``, the column to select it by; in the
    frame they have names of their own, so no name of ``docs`` can clash with those of ``ddl``.
    ``work`` gets a batch of the inputs alone.
    """
    own = {c: f"_carried{i}" for i, c in enumerate(docs.columns)}
    fields = ", ".join(f"{own[f.name]} {f.dataType.simpleString()}" for f in docs.schema)
    places, names = [docs.columns.index(c) for c in inputs], list(own.values())

    def run(batch: pa.RecordBatch, state) -> dict:
        return work(batch.select(places), state) | {x: batch.column(i) for i, x in enumerate(names)}

    frame = map_batches(docs.toDF(*names), run, f"{ddl}, {fields}", start)
    return frame, {c: F.col(x).alias(c) for c, x in own.items()}


def discard(df: DataFrame) -> None:
    """Empty a table that ``materialize`` wrote, once nothing will read it any more."""
    files = df.inputFiles()
    if files:
        df.sparkSession.range(0).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def fresh(columns: list[str], name: str) -> str:
    """``name`` or a longer one that is not in ``columns``."""
    while name in columns:
        name += "_"
    return name


def fits_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than one row over."""
    return df.limit(most_rows + 1).count() <= most_rows

