"""Columns worked out in Python, batch by batch, beside columns that stay as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of an Arrow batch, unless the session names another bound; Spark's own default is 64 MiB.
BATCH_BYTES = 8 << 20
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session now cuts Arrow batches at few bytes, so that long rows need no more memory than short ones."""
    conf = df.sparkSession.conf
    if _BOUND not in conf.getAll:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df


def with_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns ``added`` (a schema string) and without ``drop``.

    ``make`` is called once per task and gives the function from a batch to the
    new columns.  Columns of ``df`` that have a new column's name are replaced.
    """
    new = StructType.fromDDL(added)
    names = [c for c in df.columns if c not in drop and c not in new.fieldNames()]
    schema = StructType([df.schema[c] for c in names] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        types = to_arrow_schema(new)
        for batch in batches:
            columns = work(batch)
            made = [pa.array(columns[f.name], type=f.type) for f in types]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *types.names])

    return bounded(df).mapInArrow(run, schema)
