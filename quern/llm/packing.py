"""Problem 9: fill containers of fixed capacity with texts, by bounded-space online best-fit.

Each partition packs its texts in order of arrival into at most open_bins open containers per capacity. A bitset has bit f
set where an open container has f free tokens; the best fit for a text of s tokens is the lowest set bit from s upwards.
If no open container has room and all places are taken, the fullest one closes. What is open when a partition ends goes
into a second round, in groups of a fixed number of partitions: there whole containers are the items, so that a group of
partitions, not a partition, leaves containers with room. No task sees more than its own rows, or fan_in * open_bins
containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe
from quern.llm import textblocks as tb
from quern.runtime import materialise

OPEN_BINS, FAN_IN = 256, 32


class BestFit:
    """Online best-fit with a bounded number of open containers. place(size) gives the number of the container."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits, self.by_free, self.n_open, self.opened = 0, {}, 0, 0
        self.fill: dict[int, int] = {}

    def place(self, size: int) -> int:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            stack = self.by_free[free]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << free
        else:
            if self.n_open >= self.most_open:
                self._close_fullest()
            number, free = self.opened, self.capacity
            self.opened += 1
            self.n_open += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return number

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        stack = self.by_free[free]
        stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.n_open -= 1

    def still_open(self) -> set[int]:
        return {n for stack in self.by_free.values() for n in stack}


def pack(documents: DataFrame, capacities: list[tuple[int, int]], path: str = bpe.DEFAULT_VOCABULARY, open_bins: int = OPEN_BINS,
         fan_in: int = FAN_IN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(capacity_id, key, piece, first_token, n_tokens, container): every row of documents once for each capacity.

    A text longer than the capacity is cut into pieces that fill a container each, and a rest that is packed like a text.
    A null or empty text is a piece of 0 tokens in some container. Repeated rows are packed each. capacities: (id, tokens)
    pairs, a parameter of a few rows; those that are null or below 1 are left out. container is unique within its capacity."""
    capacities = [(int(i), int(c)) for i, c in capacities if i is not None and c is not None and c > 0]
    schema = documents.schema[key].dataType.simpleString()

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.word_table(path)
        partition = TaskContext.get().partitionId()
        bins = [BestFit(c, open_bins) for _, c in capacities]
        for batch in batches:
            for part in tb.chunks(batch, text):
                sizes, _ = table.encode(part.column(text), counts_only=True)
                for (number, capacity), fit in zip(capacities, bins):
                    whole, rest = np.divmod(sizes, capacity)
                    pieces = whole + ((rest > 0) | (sizes == 0))
                    row = np.repeat(np.arange(len(sizes)), pieces)
                    piece = tb.expand(np.zeros(len(sizes), np.int64), pieces)
                    size = np.where(piece < whole[row], capacity, rest[row])
                    place = fit.place
                    container = np.fromiter((place(s) for s in size.tolist()), np.int64, len(size))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), number, np.int32)), part.column(key).take(pa.array(row)), pa.array(piece.astype(np.int32)),
                         pa.array(piece * capacity), pa.array(size.astype(np.int64)), pa.array((np.int64(partition) << 32) + container), pa.array(np.zeros(len(row), bool))],
                        names)
        for (number, _), fit in zip(capacities, bins):
            left = np.array(sorted(fit.still_open()), np.int64)
            if len(left):
                free = {n: f for f, stack in fit.by_free.items() for n in stack}
                used = np.array([fit.capacity - free[n] for n in left.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(left), number, np.int32)), pa.nulls(len(left), key_type), pa.nulls(len(left), pa.int32()), pa.nulls(len(left), pa.int64()),
                     pa.array(used), pa.array((np.int64(partition) << 32) + left), pa.array(np.ones(len(left), bool))], names)

    names = ["capacity_id", key, "piece", "first_token", "n_tokens", "container", "is_open"]
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(documents.schema[key].dataType)
    if not capacities:
        return documents.sparkSession.createDataFrame([], f"capacity_id int, `{key}` {schema}, piece int, first_token bigint, n_tokens bigint, container bigint")
    rows = materialise(documents.select(key, text).mapInArrow(first_round, f"capacity_id int, `{key}` {schema}, piece int, first_token bigint, n_tokens bigint, container bigint, is_open boolean"))
    sizes = dict(capacities)

    def second_round(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "container"], ascending=[False, True])
        fit = BestFit(sizes[int(group.capacity_id.iloc[0])], len(group) + 1)
        slot = [fit.place(s) for s in group.n_tokens.tolist()]
        into = group.groupby(slot).container.transform("min")
        return pd.DataFrame({"capacity_id": group.capacity_id, "container": group.container, "into": into})

    moved = (rows.filter("is_open").select("capacity_id", "n_tokens", "container", (F.shiftright("container", 32) / F.lit(fan_in)).cast("long").alias("g"))
             .groupBy("capacity_id", "g").applyInPandas(second_round, "capacity_id int, container bigint, into bigint"))
    return (rows.filter("not is_open").join(moved, ["capacity_id", "container"], "left")
            .select("capacity_id", key, "piece", "first_token", "n_tokens", F.coalesce("into", "container").alias("container")))
