"""Filling containers of fixed capacity with texts: vector best-fit, in groups of bounded size and levels.

A container has three capacities: tokens, documents and attention cost (the sum of the squared lengths). Items go in by
descending length; of the open containers that can take an item under every capacity, the one whose remaining capacities,
each as a share and weighted, are of the least norm takes it. Open containers are kept by their remaining tokens, so a search
begins at the tightest and ends where no further container can have a lesser norm.

Items are packed in groups of about `group_tokens` tokens and GROUP_ITEMS items, hashed by document; every group leaves its `loose` emptiest
containers to the next level, where one group gets those of `merge` groups, until one group is left. No task ever gets more
than that, whatever the data, and all but a few containers of each group are as good as a packing of the whole group.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm.encode import FOLDER, STEP, TOKENIZER, Encoder
from kumiki.session import checkpointed, spread

CAPACITY, DOCUMENTS = 2048, 512
WEIGHTS = (1.0, 0.1, 0.1)
GROUP_TOKENS, GROUP_ITEMS, LOOSE, MERGE = 20_000_000, 200_000, 16, 16


def sized(docs: DataFrame, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """(doc_id, n): tokens of each text; 0 for null and empty ones."""
    path = f"{folder}/{tokenizer}.json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = None
        for b in batches:
            e = e or Encoder(path)
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                n = [len(x) // 4 for x in e.batch(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n"])

    return spread(docs.select("doc_id", "text"), "doc_id", per_slot=1).mapInArrow(run, "doc_id long, n long")


def best_fit(sizes: list[int], capacity: int, documents: int, attention: int, weights: tuple[float, float, float] = WEIGHTS) -> list[int]:
    """The container of each item; `sizes` descends and none exceeds the capacity alone."""
    left: list[int] = []
    room: list[tuple[int, int, int]] = []  # documents, attention, and the container
    at: dict[int, list[tuple[int, int, int]]] = {}
    levels: list[int] = []
    out: list[int] = []
    wt, wd, wa = weights[0] / capacity, weights[1] / documents, weights[2] / attention
    least_d, least_a = documents, attention  # no container has less
    for n in sizes:
        best, norm, square = -1, 0.0, n * n
        rest = (max(least_d - 1, 0) * wd) ** 2 + (max(least_a - square, 0) * wa) ** 2
        for k in range(bisect_left(levels, n), len(levels)):
            x = ((levels[k] - n) * wt) ** 2
            if best >= 0 and x + rest >= norm:
                break
            for d, a, c in at[levels[k]]:
                v = x + ((d - 1) * wd) ** 2
                if best >= 0 and v >= norm:
                    break  # the others of this level have no fewer documents left
                if a >= square:
                    v += ((a - square) * wa) ** 2
                    if best < 0 or v < norm:
                        best, norm = c, v
        if best < 0:
            best = len(left)
            left.append(capacity)
            room.append((documents, attention, best))
        else:
            old = at[left[best]]
            del old[bisect_left(old, room[best])]
            if not old:
                del at[left[best]]
                levels.pop(bisect_left(levels, left[best]))
        left[best] -= n
        d, a = room[best][0] - 1, room[best][1] - square
        room[best] = (d, a, best)
        out.append(best)
        if left[best] and d and a:  # a container without room for one more token is closed
            least_d, least_a = min(least_d, d), min(least_a, a)
            if left[best] not in at:
                insort(levels, left[best])
                at[left[best]] = []
            insort(at[left[best]], room[best])
    return out


def _packed(capacity: int, documents: int, attention: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple[int, int, int, int]]] = {}
        for b in batches:
            for g, *item in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "doc_id", "piece", "start"))):
                groups.setdefault(g, []).append(tuple(item))
        for g, items in sorted(groups.items()):
            items.sort(key=lambda x: (-x[0], x[1:]))
            where = best_fit([x[0] for x in items], capacity, documents, attention)
            fill: dict[int, int] = {}
            for x, c in zip(items, where):
                fill[c] = fill.get(c, 0) + x[0]
            loose = set() if last else set(sorted((c for c in fill if fill[c] < capacity), key=lambda c: (fill[c], c))[:LOOSE])
            name = {c: int.from_bytes(hashlib.blake2b(f"{level}/{g}/{c}".encode(), digest_size=8).digest(), "little", signed=True) for c in fill}
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([x[1] for x in items], pa.int64()), "piece": pa.array([x[2] for x in items], pa.int32()),
                "start": pa.array([x[3] for x in items], pa.int64()), "n": pa.array([x[0] for x in items], pa.int64()),
                "container": pa.array([None if c in loose else name[c] for c in where], pa.int64()), "grp": pa.array([g] * len(items), pa.int64()),
            })

    return run


def packed(sizes: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: int | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(container, doc_id, piece, start, n): each text's place; `start` and `n` in tokens of the text.

    Only a text above a capacity is split, into the greatest pieces that a container can hold and a rest. Texts without tokens
    need no room: they come out with a null container and n = 0. `attention` is the greatest sum of squared lengths; by default
    capacity squared, which never binds. Null sizes are as 0.
    """
    attention = attention or capacity * capacity
    if min(capacity, documents, attention) < 1:
        raise ValueError("capacities must be positive")
    whole = min(capacity, isqrt(attention))  # the longest item that fits a container of its own
    sizes = checkpointed(sizes.select("doc_id", F.coalesce("n", F.lit(0)).alias("n")))
    items = sizes.where("n > 0").select(
        "doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(whole).cast("long"))).alias("piece", "start"), F.col("n").alias("all")
    ).select("doc_id", "piece", "start", F.least(F.col("all") - F.col("start"), F.lit(whole)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.ceil(F.col("n") / whole)), F.lit(0)).alias("items")).first()
    groups = max(1, -(-total["n"] // group_tokens), -(-total["items"] // GROUP_ITEMS))
    schema = "doc_id long, piece int, start long, n long, container long, grp long"
    todo = items.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    done = None
    level = 0
    while True:
        run = _packed(capacity, documents, attention, level, groups == 1)
        got = checkpointed(todo.repartitionById(int(groups), F.col("grp").cast("int")).mapInArrow(run, schema))
        full = got.where("container IS NOT NULL")
        done = full if done is None else done.unionByName(full)
        if groups == 1:
            break
        groups = -(-groups // MERGE)
        level += 1
        todo = got.where("container IS NULL").select("doc_id", "piece", "start", "n", F.floor(F.col("grp") / MERGE).alias("grp"))
    none = sizes.where("n = 0").select(F.lit(None).cast("long").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n")
    return done.select("container", "doc_id", "piece", "start", "n").unionByName(none)
