"""Row-wise Python work on one text column; all other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

STEP = 256


def neutral(frame: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame with columns named by their place, and the new name of each: no name of a caller meets one used inside."""
    names = {c: f"in{i}" for i, c in enumerate(frame.columns)}
    return frame.toDF(*names.values()), names


def add_columns(
    rows: DataFrame, text: Column, keep: Mapping[str, Column], schema: str, work: Callable[[list], Mapping[str, list]]
) -> DataFrame:
    """The ``keep`` columns and those that ``work`` gives for each text, in ``schema``.

    Kept columns stay Arrow arrays, so nulls and large numbers do not change;
    texts go through ``work`` in runs of a few hundred.
    """
    named = [c.alias(f"_k{i}") for i, c in enumerate(keep.values())]
    chosen = rows.select(*named, text.alias("_text"))
    kept = [f for f in chosen.schema if f.name != "_text"]
    added = StructType.fromDDL(schema)
    kinds = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches):
        for batch in batches:
            out = {name: [] for name in kinds}
            for at in range(0, batch.num_rows, STEP):
                for name, values in work(batch.column("_text").slice(at, STEP).to_pylist()).items():
                    out[name].extend(values)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(out[n], type=k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + list(kinds))

    done = chosen.mapInArrow(run, StructType(kept + list(added)))
    return done.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)], *[F.col(f"`{f.name}`") for f in added])
