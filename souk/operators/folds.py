"""Ordered per-key folds for rules whose outcome depends on earlier requests.

A rule such as "accept the order only if the balance left by the earlier
accepted orders covers it" has no associative summary, so it is a scan in
(ts, request_id) order per key. The scan here never gathers a key's rows
into one value: rows are hash-partitioned by key, sorted inside each
partition, and streamed through ``mapInPandas`` in Arrow batches while the
state of the current key is carried from row to row (and across batch
boundaries). Memory per task is one batch plus one state, whatever the size
of a key; a retried task re-reads the same sorted input and gives the same
output.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def ordered_fold(events: DataFrame, key: str | list[str], order: list[str],
                 init: Callable[[dict], object],
                 step: Callable[[object, dict], tuple[object, dict]],
                 out_schema: str, partitions: int | None = None,
                 finish: Callable[[object, dict], dict] | None = None,
                 sort_only: list[str] | None = None) -> DataFrame:
    """Run ``step`` over each key's events in ``order``.

    ``init(row)`` builds the key's state from its first row (so a starting
    balance or status travels on the rows); ``step(state, row)`` returns the
    new state and the output record for that row — a tuple in ``out_schema``
    order — or ``None`` for no output.
    With ``finish(state, last_row)`` one more record is emitted when a key ends.
    ``key`` may be several columns. Columns in ``sort_only`` order the rows but
    are not handed to ``step`` (they are dropped after the sort, which keeps the
    order), so no Python objects are built for them.
    """
    from souk.session import ship_package
    ship_package(events.sparkSession)
    keys = [key] if isinstance(key, str) else list(key)
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_events = events.repartition(n, *keys).sortWithinPartitions(*keys, *order)
    if sort_only:
        sorted_events = sorted_events.drop(*sort_only)
    # top-level commas only: ``decimal(12,2)`` holds one
    out_cols = [f.strip().split(" ")[0] for f in re.split(r",(?![^()]*\))", out_schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = object()
        state, last = None, None
        for pdf in batches:
            out = []
            cols = list(pdf.columns)
            for values in zip(*[pdf[c].tolist() for c in cols]):
                row = dict(zip(cols, values))
                k = tuple(row[c] for c in keys)
                if k != current:
                    if finish is not None and last is not None:
                        out.append(finish(state, last))
                    current, state = k, init(row)
                state, rec = step(state, row)
                last = row
                if rec is not None:
                    out.append(rec)
            yield pd.DataFrame.from_records(out, columns=out_cols)
        if finish is not None and last is not None:
            yield pd.DataFrame.from_records([finish(state, last)], columns=out_cols)

    return sorted_events.mapInPandas(run, out_schema)


def _starts(pdf: pd.DataFrame, keys: list[str], last: pd.DataFrame | None) -> np.ndarray:
    """Which rows begin a key: those that differ from the row before, ``last`` before the first one (nulls are equal)."""
    out = np.zeros(len(pdf), bool)
    out[0] = last is None
    for k in keys:
        a = pdf[k] if last is None else pd.concat([last[k], pdf[k]])
        v, none = a.to_numpy(), a.isna().to_numpy()
        out[len(pdf) + 1 - len(a):] |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return out


def ordered_scan(events: DataFrame, key: list[str], order: list[str], make: Callable[[], Callable], added: str,
                 keep: list[str], ends: bool = False) -> DataFrame:
    """``ordered_fold`` for steps over a few plain columns: no dict or tuple a row.

    ``make()`` gives a task's ``advance(first, pdf)``: ``first`` tells per row whether a key begins,
    the result is one list per column of the schema ``added``. It carries the state of the current key
    to the next Arrow batch. ``keep`` columns pass through. With ``ends`` only the last row of every
    key is returned. Columns of ``order`` in neither ``keep`` nor ``key`` are dropped after the sort.
    """
    from souk.session import ship_package
    spark = events.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.repartition(n, *key).sortWithinPartitions(*key, *order).drop(*[c for c in order if c not in keep and c not in key])
    new = T.StructType.fromDDL(added)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        advance, last, held = make(), None, None
        for pdf in batches:
            if pdf.empty:
                continue
            first = _starts(pdf, key, last)
            out = pdf[keep].assign(**dict(zip(new.names, advance(first.tolist(), pdf))))
            last = pdf[key].iloc[-1:]
            if not ends:
                yield out
                continue
            if held is not None and first[0]:
                yield held
            yield out.iloc[np.flatnonzero(first[1:])]
            held = out.iloc[-1:]
        if held is not None:
            yield held

    return rows.mapInPandas(run, T.StructType([*[rows.schema[c] for c in keep], *new.fields]))


def sorted_scan(rows: DataFrame, inputs: dict[str, Column], make: Callable[[], Callable], added: str) -> DataFrame:
    """``rows`` (partitioned and sorted already) plus the columns of ``added``, computed partition by partition.

    ``make()`` gives a task's ``advance``, which gets an Arrow batch of ``inputs`` as one list each and returns
    one list per added column; it carries its state to the next batch. The rows' own columns pass as
    Arrow arrays: no Python object is built for them.
    """
    from souk.session import ship_package
    ship_package(rows.sparkSession)
    new, own = T.StructType.fromDDL(added), rows.columns
    given, asked = rows.select("*", *[c.alias(f"_in_{n}") for n, c in inputs.items()]), [f"_in_{n}" for n in inputs]
    kinds = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64() for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        advance = make()
        for batch in batches:
            out = advance(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in asked])
            arrays = [batch.column(i) for i in range(len(own))] + [pa.array(v, k) for v, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [*own, *new.names])

    return given.mapInArrow(run, T.StructType([*rows.schema.fields, *new.fields]))
