"""Streams with state: the latest result of each key, as results come in, out of order and after restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How times pass through JSON without losing microseconds.
OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def latest(results: DataFrame, key: str, time: str, *ties: str, delay: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """A row of a stream of results for each key whose latest result changes, by `time` and then by `ties` (whole
    numbers or times; nulls first). The last row of a key equals what `stateless.latest` gives for the table.

    Results later than the watermark (`delay` behind the newest time) are dropped, as are those without a time. A key's
    state is its latest order only; it goes when the watermark is `keep_ms` past it. That loses nothing: what could
    still come for the key and be older is later than the watermark, too. Columns pass as JSON, so that large numbers
    beside nulls stay what they are.
    """
    columns = results.schema
    whole = [F.unix_micros(time) if c == time else F.unix_micros(c) if isinstance(columns[c].dataType, T.TimestampType) else F.col(c).cast("long") for c in (time, *ties)]
    sent = results.where(F.col(time).isNotNull()).withWatermark(time, delay).select(F.col(key), F.col(time), F.to_json(F.array(*whole), {"ignoreNullFields": "false"}).alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in results.columns]), OPTIONS).alias("row"))

    def order(place: str) -> tuple:
        return tuple((v is not None, v or 0) for v in json.loads(place))

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        late = state.getCurrentWatermarkMs()
        old = order(state.get[0]) if state.exists else None
        best, row = old, None
        for batch in batches:
            for place, text in zip(batch["place"], batch["row"], strict=True):
                own = order(place)
                if own[0][1] // 1000 >= late and (best is None or own > best):
                    best, row = own, text
        if row is None:
            return
        state.update((json.dumps([v if known else None for known, v in best]),))
        state.setTimeoutTimestamp(max(best[0][1] // 1000, late) + keep_ms)
        yield pd.DataFrame({"row": [row]})

    out = sent.groupBy(key).applyInPandasWithState(step, "row string", "place string", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("row", columns, OPTIONS).alias("r")).select("r.*")
