"""Links between 64-bit fingerprints within a Hamming radius, by BK-trees over shards.

Sharding: cut the 64 bits into radius + 1 blocks. Two fingerprints within the radius agree on at least one block, so a
shard holds all fingerprints with the same value of a block, and every link lies in some shard. A shard above
``MOST_NODES`` is cut again on the bits still free, by the same argument; after ``LEVELS`` cuts so few bits are free that
no shard can be larger. So every tree has a proven bound, no fingerprint or partner is dropped, and neither a dense
group nor a block value shared by a third of the rows ends in one task.

Trees: inside a shard each fingerprint is searched in the BK-tree of those before it (children keyed by the Hamming
distance to the parent, only edges within the radius of the distance are followed), joined with what is found, then
inserted. A shard gives one row for each fingerprint that has a link: the fingerprint and the first of its local group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyward.sources.staging import stage

RADIUS = 2
MOST_NODES = 4096
LEVELS = 5
SALTS = 32


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def cuts_of(mask: int, parts: int) -> list[int]:
    """``mask`` with one more of ``parts`` equal runs of its free bits, once for each run."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in run.tolist()) for run in np.array_split(free, parts)]


class BKTree:
    """Nodes in arrays; ``edges[i]`` maps a distance to the child whose subtree lies at that distance from node i."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> tuple[int, list[int]]:
        """Insert a value; its number and the numbers of the earlier nodes within the radius."""
        found, values, edges = [], self.values, self.edges
        number = len(values)
        if number:
            todo = [0]
            while todo:
                node = todo.pop()
                d = (values[node] ^ value).bit_count()
                if d <= radius:
                    found.append(node)
                kids = edges[node]
                if len(kids) <= 2 * radius + 1:
                    todo += [kid for at, kid in kids.items() if d - radius <= at <= d + radius]
                else:
                    todo += [kids[at] for at in range(d - radius, d + radius + 1) if at in kids]
            node = 0
            while (d := (values[node] ^ value).bit_count()) in edges[node]:
                node = edges[node][d]
            edges[node][d] = number
        values.append(value)
        edges.append({})
        return number, found


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, first value of its group) for the groups that links within the radius form among distinct values,
    given without a sign: a negative number would be counted by the bits of its magnitude."""
    tree, parent = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        number, found = tree.add(value, radius)
        for other in found:
            a, b = top(number), top(other)
            parent[max(a, b)] = min(a, b)
    return [(v, values[t]) for i, v in enumerate(values) if (t := top(i)) != i]


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shards: list[np.ndarray]) -> pa.RecordBatch:
            pairs = [p for s in shards if len(s) > 1 for p in local_links(s.view(np.uint64).tolist(), radius)]
            ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        rest, rest_key = np.empty(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            level, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero((level[1:] != level[:-1]) | (key[1:] != key[:-1])) + 1
            shards = np.split(fp, starts)
            if rest_key == (level[0], key[0]):
                shards[0] = np.concatenate([rest, shards[0]])
            else:
                shards.insert(0, rest)
            rest, rest_key = shards.pop(), (level[-1], key[-1])  # the last shard may go on in the next batch
            yield out(shards)
        yield out([rest])

    return run


def _in_shards(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """A row for each of the cuts that belong to the row's ``shard`` (number of a mask)."""
    each = F.array(*(F.array(*(F.struct(F.lit(n).alias("shard"), (F.col("fp").bitwiseAND(F.lit(signed(m)))).alias("key")) for n, m in kids)) for kids in masks.values()))
    place = F.create_map(*(F.lit(x) for pair in ((s, i) for i, s in enumerate(masks)) for x in pair))
    return rows.select(F.explode(each[place[F.col("shard")]]).alias("s"), "fp").select("s.shard", "s.key", "fp")


def links(distinct: DataFrame, radius: int = RADIUS, most_nodes: int = MOST_NODES, levels: int = LEVELS) -> DataFrame:
    """Edges ``a``, ``b`` that connect all fingerprints (``fp``, long, distinct) with a chain of links of the radius."""
    number, masks = 1, {0: [(1 + i, m) for i, m in enumerate(cuts_of(0, radius + 1))]}
    known = dict(masks[0])
    number += len(known)
    todo, found = _in_shards(distinct.select(F.lit(0).alias("shard"), "fp"), masks), None
    for level in range(levels):
        hot = stage(todo.groupBy("shard", "key").count().filter(F.col("count") > most_nodes).select("shard", "key"), "hot")
        last = level == levels - 1 or hot.isEmpty()
        small = todo
        if not last:
            # Hot keys are copied to salts, so that a shard with very many rows is probed by many tasks.
            salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = todo.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
            small = rows.join(salted, ["shard", "key", "salt"], "left_anti").drop("salt")
            large = rows.join(salted, ["shard", "key", "salt"], "left_semi")
        shards = small.repartition("shard", "key").sortWithinPartitions("shard", "key", "fp").select("shard", "key", "fp")
        linked = shards.mapInArrow(_linked(radius), "a long, b long").distinct()
        found = linked if found is None else found.union(linked)
        if last:
            break
        masks, before = {}, known
        known = {}
        for s, m in before.items():
            masks[s] = [(number + i, c) for i, c in enumerate(cuts_of(m, radius + 1))]
            number += len(masks[s])
            known |= dict(masks[s])
        todo = stage(_in_shards(large, masks), "shards")
    return found
