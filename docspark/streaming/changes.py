"""The change counter as a stateful stream: one count and the last tracked values for each entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(stream: DataFrame, entity: str, order: str, tracked: str) -> DataFrame:
    """entity, order, tracked and change (changes so far) for each row of a stream; rows of a batch are taken in order.

    State is two values an entity, whatever its history.
    """
    columns = [entity, order, tracked]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, held = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for value in rows[tracked]:
            value = str(value)
            count += held is not None and value != held
            held = value
            out.append(count)
        state.update((count, held))
        yield rows.assign(change=out)[[*columns, "change"]]

    schema = stream.select(*columns).schema.add("change", "long")
    return stream.select(*columns).groupBy(entity).applyInPandasWithState(step, schema, "count long, held string", "append", GroupStateTimeout.NoTimeout)
