"""What follows what, in order, without gathering a group into one task."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.lineage import cut

PART = "_part"


def with_previous(rows: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with `before`, a struct of `columns` of the row before them in the order of all rows, null for the first one.

    The rows are sorted by ranges of `order`, so one long group lies in many partitions. Within a partition a row's
    predecessor is at hand; the first row's is the last row of the nearest partition before that has any, so one row for each
    partition goes through the driver. Rows that are equal in `order` stand in any order. Column names are kept.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))
    types = {f.name: f.dataType for f in rows.schema.fields}

    def last_rows(batches):
        last = None
        for b in batches:
            if b.num_rows:
                last = b.slice(b.num_rows - 1)
        if last is not None:
            yield last

    light = placed.select(PART, *columns)
    ends = {r[PART]: tuple(r[c] for c in columns) for r in light.mapInArrow(last_rows, light.schema).collect()}
    before, known = {}, None
    for part in sorted(ends):
        before[part], known = known, ends[part]

    def shifted(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            if held is None:
                first = before[b.column(PART)[0].as_py()]
                held = [pa.array([None if first is None else v], b.schema.field(c).type) for c, v in zip(columns, first or columns)]
                empty = first is None
            moved = [pa.concat_arrays([h, b.column(c).slice(0, b.num_rows - 1)]) for h, c in zip(held, columns)]
            held = [b.column(c).slice(b.num_rows - 1) for c in columns]
            none = pa.array([empty, *[False] * (b.num_rows - 1)])
            empty = False
            kept = [b.column(c) for c in types]
            yield pa.RecordBatch.from_arrays([*kept, pa.StructArray.from_arrays(moved, columns, mask=none)], [*types, "before"])

    fields = ", ".join(f"`{c}` {types[c].simpleString()}" for c in columns)
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in types.items())
    return placed.mapInArrow(shifted, f"{schema}, before struct<{fields.replace('` ', '`: ')}>")
