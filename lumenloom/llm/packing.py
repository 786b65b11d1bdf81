"""Filling containers of fixed capacity with texts measured in tokens.

Sum-of-squares packing: each text goes where the sum over fill levels of the
squared number of open containers at that level becomes least, which keeps the
levels spread so that later texts find a gap that fits. Texts are placed in
independent shards of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts packed together by one task for each capacity.
SHARD_ITEMS = 20_000
#: Most capacities; the driver holds a row for each.
MOST_CAPACITIES = 1_000


class SumOfSquares:
    """Online placement by the sum-of-squares rule, tracked in an array of fill levels."""

    def __init__(self, capacity: int) -> None:
        if capacity < 1:
            raise ValueError("a capacity must be at least 1")
        self.capacity = capacity
        self.at_level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.levels: list[int] = []

    def place(self, size: int) -> int:
        """Puts an item of 1..capacity into the container that the rule names; returns its number.

        Of equal choices the fullest container is taken, a new one last.
        """
        n, room = self.at_level, self.capacity - size
        best, level = (0 if room == 0 else 2 * n[size] + 1), 0
        if room > 0:
            used = np.flatnonzero(n[1 : room + 1]) + 1
            if len(used):
                change = 2 * (n[used + size] - n[used]) + 2
                if used[-1] == room:
                    change[-1] = 1 - 2 * n[room]
                least = change.min()
                if least <= best:
                    level = int(used[len(change) - 1 - int(np.argmin(change[::-1]))])
        if level:
            number = self.open[level].pop()
            n[level] -= 1
        else:
            number = len(self.levels)
            self.levels.append(0)
        level += size
        self.levels[number] = level
        if level < self.capacity:
            n[level] += 1
            self.open[level].append(number)
        return number

    def merge_open(self) -> dict[int, int]:
        """Empties open containers into others where they fit as a whole: old number to new, fullest first into the fullest that has room."""
        moved: dict[int, int] = {}
        rest = sorted((i for i, v in enumerate(self.levels) if 0 < v < self.capacity), key=lambda i: (-self.levels[i], i))
        by_level: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        filled = np.zeros(self.capacity + 1, dtype=bool)
        for number in rest:
            size = self.levels[number]
            fits = np.flatnonzero(filled[: self.capacity - size + 1])
            into = number
            level = 0
            if len(fits):
                level = int(fits[-1])
                into = by_level[level].pop()
                filled[level] = bool(by_level[level])
                moved[number] = into
                self.levels[number] = 0
                self.levels[into] = level + size
            by_level[level + size].append(into)
            filled[level + size] = level + size < self.capacity
        return moved


def pack(sizes: Sequence[int], capacity: int) -> pd.DataFrame:
    """item (its place in `sizes`), piece, start, size, container for every piece.

    An item longer than the capacity is cut into full containers and a rest,
    which is placed like any other item; no other item is divided. Items of
    size 0 go into the first container. Containers are numbered from 0 without gaps.
    """
    packer = SumOfSquares(capacity)
    items: list[int] = []
    pieces: list[int] = []
    starts: list[int] = []
    parts: list[int] = []
    homes: list[int] = []
    empty: list[int] = []
    for item, size in enumerate(sizes):
        if size <= 0:
            empty.append(item)
        for piece in range(math.ceil(size / capacity)):
            part = min(capacity, size - piece * capacity)
            items.append(item)
            pieces.append(piece)
            starts.append(piece * capacity)
            parts.append(part)
            homes.append(packer.place(part))
    moved = packer.merge_open()
    kept = {}
    final = []
    for home in homes:
        home = moved.get(home, home)
        while home in moved:
            home = moved[home]
        final.append(kept.setdefault(home, len(kept)))
    n = len(empty)
    return pd.DataFrame({
        "item": np.array(items + empty, dtype=np.int64), "piece": np.array(pieces + [0] * n, dtype=np.int32), "start": np.array(starts + [0] * n, dtype=np.int32),
        "size": np.array(parts + [0] * n, dtype=np.int32), "container": np.array(final + [0] * n, dtype=np.int64),
    })


def pack_corpus(sizes: DataFrame, capacities: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", shard_items: int = SHARD_ITEMS, total: int | None = None) -> DataFrame:
    """Every text in containers of every capacity: capacity_id, container, id, piece, start, n_tokens.

    `container` is unique within its capacity_id. Texts are sharded by a hash of
    their id into groups of about `shard_items`, packed in the order of that hash,
    so the result depends on the data alone. A null size counts as 0; texts of
    size 0 take no room and go into their shard's first container. Capacities
    that are null or below 1 are left out. Ids should be unique; repeated ones
    are packed as separate texts of the same shard. `total`, the number of texts,
    is counted if not given, which works out the sizes once more. An empty table
    or no capacity gives no row.
    """
    items = sizes.count() if total is None else total
    shards = max(1, math.ceil(items / shard_items))
    id_type = sizes.schema[id_column].dataType.simpleString()
    rows = capacities.where("capacity_tokens >= 1").select("capacity_id", "capacity_tokens").limit(MOST_CAPACITIES + 1).collect()
    if len(rows) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    each = [F.struct(F.lit(r.capacity_id).cast("int").alias("capacity_id"), F.lit(r.capacity_tokens).cast("int").alias("capacity_tokens")) for r in rows]
    wanted = F.array(*each) if each else F.from_json(F.lit("[]"), "array<struct<capacity_id:int,capacity_tokens:int>>")
    keyed = sizes.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("int").alias("size"), F.xxhash64(F.col(id_column)).alias("order"))
    placed = keyed.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")).select("*", F.inline(wanted))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "size"], kind="stable", ignore_index=True)
        packed = pack(group["size"].tolist(), int(group["capacity_tokens"].iloc[0]))
        return pd.DataFrame({
            "capacity_id": group["capacity_id"].iloc[0], "container": packed["container"] + (int(group["shard"].iloc[0]) << 32), "id": group["id"].to_numpy()[packed["item"]],
            "piece": packed["piece"], "start": packed["start"], "n_tokens": packed["size"],
        })

    out = placed.groupBy("capacity_id", "shard").applyInPandas(run, f"capacity_id int, container bigint, id {id_type}, piece int, start int, n_tokens int")
    return out.withColumnRenamed("id", id_column)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least containers possible by volume, unused tokens and fill (tokens / room)."""
    used = packed.groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("tokens"))
    per = used.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(capacities, "capacity_id").select(
        "capacity_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"),
    )


def packing_checks(packed: DataFrame, capacities: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per capacity: n_documents in the packing, n_overfull containers, n_wrongly_divided texts (in pieces though they fit), n_gaps (texts whose pieces don't lie end to end)."""
    rooms = F.broadcast(capacities.select("capacity_id", "capacity_tokens"))
    over = packed.groupBy("capacity_id", "container").agg(F.sum("n_tokens").alias("tokens")).join(rooms, "capacity_id").groupBy("capacity_id").agg(F.count(F.when(F.col("tokens") > F.col("capacity_tokens"), 1)).alias("n_overfull"))
    texts = packed.groupBy("capacity_id", id_column).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("reach"), F.count_distinct("start").alias("starts")).join(rooms, "capacity_id")
    per = texts.groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens")), 1)).alias("n_wrongly_divided"),
        F.count(F.when((F.col("reach") != F.col("tokens")) | (F.col("starts") != F.col("pieces")), 1)).alias("n_gaps"),
    )
    return per.join(over, "capacity_id").select("capacity_id", "n_documents", "n_overfull", "n_wrongly_divided", "n_gaps")
