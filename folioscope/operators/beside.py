"""Rows next to the record that they are about, such as quotes next to the text of their page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.operators.components import looked_up

#: Rows that one copy of a record is read beside.
MOST_ROWS = 10_000


def told_beside(rows: DataFrame, holders: DataFrame, key: str, uses: list[str], open_: Callable[[dict], object], tell: Callable[[object, dict], object], result: str, kind: T.DataType, most: int = MOST_ROWS) -> DataFrame:
    """``rows`` with what ``tell`` says of each next to its holder, the row of ``holders`` (one for each key) with its key.

    ``open_`` prepares a holder (all its columns), once for all the rows that follow it: a
    holder is sent once, not with each row, and once more for every ``most`` rows, so that
    one that most rows are about is shared among tasks. Rows without a holder get null.
    """
    own, tag = [c for c in holders.columns if c != key], "_beside"
    shares = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(f"{tag}_shares"))
    here = looked_up(rows.where(F.col(key).isNotNull()), shares, key)
    here = here.withColumn(f"{tag}_share", F.pmod(F.xxhash64(*rows.columns), F.col(f"{tag}_shares")).cast("int")).withColumn(f"{tag}_step", F.lit(1)).drop(f"{tag}_shares")
    sent = holders.join(shares, key).select(
        key, F.struct(*own).alias(f"{tag}_held"), F.explode(F.sequence(F.lit(0), F.col(f"{tag}_shares") - 1)).alias(f"{tag}_share"), F.lit(0).alias(f"{tag}_step")
    )
    met = here.unionByName(sent, allowMissingColumns=True).repartition(key, f"{tag}_share").sortWithinPartitions(key, f"{tag}_share", f"{tag}_step")
    columns, told = rows.columns, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            steps = batch.column(f"{tag}_step").to_pylist()
            places = list(zip(batch.column(key).to_pylist(), batch.column(f"{tag}_share").to_pylist()))
            values = [batch.column(c).to_pylist() for c in uses]
            said = []
            for k, (step, place) in enumerate(zip(steps, places)):
                if place != at:
                    at, held = place, None
                if step == 0:
                    held = open_(batch.column(f"{tag}_held")[k].as_py())
                else:
                    said.append(None if held is None else tell(held, {c: v[k] for c, v in zip(uses, values)}))
            if said:
                kept = batch.filter(pa.array([s == 1 for s in steps])).select(columns)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(said, told)], names=[*columns, result])

    schema = T.StructType([*rows.schema.fields, T.StructField(result, kind)])
    return met.mapInArrow(run, schema).unionByName(rows.where(F.col(key).isNull()).withColumn(result, F.lit(None).cast(kind)))
