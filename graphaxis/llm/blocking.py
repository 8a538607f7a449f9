"""From block keys to verified links and components, without all pairs of a group.

Items that share a block key are candidates. Blocks are read as runs of a sorted partition, so
memory never holds one. In a run of up to ``SMALL`` items every pair that passes the guard is a
candidate; in a longer one each item is paired with one lead only, the first of a few that passes the
guard, and its membership is kept. A lead is the item nearest to the majority of the guards' bits, so
that of a text and its variants the text leads. Candidates are verified and joined into components. Then the exact rest: an item of a long
block outside of the block's largest component is paired with every item of the block in another
component. Pairs inside one component need no test, so a block of copies stays linear and no link
between two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphaxis.llm.components import components
from graphaxis.llm.scratch import discard, materialise

SMALL = 12
#: Leads of a longer run, and how many of its items they are chosen from; of a run that has less than
#: the least the first item leads.
LEADS, LEAST_SEEN, SEEN = 4, 96, 2048
#: An item's guard is two longs; this takes those of two items side by side, as arrays of two rows,
#: and gives which pairs may pass.
Guard = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: From the payloads of some items and of others to the matrix of which are links.
Linked = Callable[[pa.Array, pa.Array], np.ndarray]
#: A second, longer guard for the rest: from ``node`` and ``payload`` to ``node`` and ``f``, and which pairs
#: may pass by their ``g`` and their ``f``. Few items need it, so it is not carried in the blocks.
Finer = tuple[Callable[[DataFrame], DataFrame], Callable[[Column, Column, Column, Column], Column]]
TILE = 256


def _runs(close: Guard) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((4, 0), dtype=np.int64)  # key, node and guards of the last run, which may go on
        rest, long_key, leads = none, None, none
        for batch in batches:
            rows = np.concatenate([rest, np.stack([batch.column(i).to_numpy() for i in range(4)])], axis=1)
            # Most keys are of one item only, which has no partner; the last key may go on.
            same = rows[0, 1:] == rows[0, :-1]
            use = np.append(same, True)[: rows.shape[1]]
            use[1:] |= same
            use[:1] |= long_key is not None and rows[0, :1] == long_key
            rows = rows[:, use]
            # An item that several tasks gave to a block stands once in a batch. What the batches of a
            # long run repeat is harmless: candidates and links are made distinct later.
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            rows = rows[:, np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))[: rows.shape[1]]]
            if long_key is not None and rows.shape[1]:
                n = int(np.searchsorted(rows[0], long_key, "right"))
                yield from _part_of_long(rows[:, :n], leads, close)
                rows = rows[:, n:]
                if not rows.shape[1]:
                    rest = none
                    continue
                long_key = None
            start = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield from _whole(rows[:, :start], close)
            rest = rows[:, start:]
            if rest.shape[1] > SMALL:
                long_key, leads = int(rest[0, 0]), _leads(rest, close)
                yield from _part_of_long(rest, leads, close)
                rest = none
        yield from _whole(rest, close)

    return scan


_FOUND = "u long, v long, lead long, key long, g long, h long"


def _pairs(u: np.ndarray, v: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(lead), none, none, none], names=["u", "v", "lead", "key", "g", "h"])


def _leads(rows: np.ndarray, close: Guard) -> np.ndarray:
    """Up to ``LEADS`` items that most others of a run are near to, as columns."""
    if rows.shape[1] < LEAST_SEEN:
        return rows[:, :1]
    left = rows[:, :: -(-rows.shape[1] // SEEN)]
    leads = []
    while left.shape[1] and len(leads) < LEADS:
        bits = np.unpackbits(np.ascontiguousarray(left[2:].T).view(np.uint8), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view(np.int64)
        far = np.bitwise_count((left[2:] ^ middle[:, None]).view(np.uint64)).sum(axis=0)
        leads.append(left[:, [int(np.argmin(far))]])
        left = left[:, ~close(np.repeat(leads[-1][2:], left.shape[1], axis=1), left[2:]) & (left[1] != leads[-1][1])]
    return np.concatenate(leads, axis=1)


def _part_of_long(rows: np.ndarray, leads: np.ndarray, close: Guard) -> Iterator[pa.RecordBatch]:
    """Memberships of a long run, and its items paired with the first lead that passes the guard."""
    if not rows.shape[1]:
        return
    none = pa.nulls(rows.shape[1], pa.int64())
    yield pa.RecordBatch.from_arrays([none, pa.array(rows[1]), none, *[pa.array(rows[i]) for i in (0, 2, 3)]], names=["u", "v", "lead", "key", "g", "h"])
    free = ~np.isin(rows[1], leads[1])
    for j in range(leads.shape[1]):
        lead = np.repeat(leads[:, [j]], rows.shape[1], axis=1)
        pick = free & close(lead[2:], rows[2:])
        free &= ~pick
        yield _pairs(lead[1, pick], rows[1, pick], np.full(int(pick.sum()), leads[1, 0]))


def _whole(rows: np.ndarray, close: Guard) -> Iterator[pa.RecordBatch]:
    """Complete runs, small and long."""
    n = rows.shape[1]
    if n < 2:
        return
    edge = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    size = np.diff(np.append(edge, n))
    for a, k in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist()):
        run = rows[:, a : a + k]
        yield from _part_of_long(run, _leads(run, close), close)
    use = np.repeat((size > 1) & (size <= SMALL), size)
    lead = np.repeat(rows[1, edge], size)[use]
    rows = rows[:, use]
    for step in range(1, SMALL):
        i = np.flatnonzero(rows[0, step:] == rows[0, :-step])
        if not len(i):
            break
        j = i + step
        pick = (rows[1, i] != rows[1, j]) & close(rows[2:, i], rows[2:, j])
        yield _pairs(rows[1, i[pick]], rows[1, j[pick]], lead[i[pick]])


def link(blocks: DataFrame, close: Guard, close_sql: Callable[[Column, Column, Column, Column], Column], payload: DataFrame, verify: Callable[[DataFrame], DataFrame], linked: Linked | None = None, finer: Finer | None = None) -> DataFrame:
    """``node`` and ``component`` of every linked item.

    ``blocks``: ``key``, ``node``, and the guard ``g``, ``h`` (longs). ``close`` and ``close_sql`` are one
    guard, for arrays and for columns. ``payload``: ``node`` and what is compared, read once for the
    items that are candidates. ``verify``: from pairs with their payloads ``a`` and ``b`` to those rows that are
    links. ``linked``: how payloads are compared where the rest is to be compared inside tasks
    instead of as a table of pairs.
    """
    # By the key alone, which Spark sorts by radix; items of a key are ordered in each batch.
    dealt = blocks.select("key", "node", "g", "h").repartition("key").sortWithinPartitions("key")
    found = materialise(dealt.mapInArrow(_runs(close), _FOUND), "candidates", 1 << 16)
    nodes = found.select(F.col("v").alias("node")).union(found.where("u is not null").select("u")).distinct()
    # The distinct nodes of a partition are hashed, so that the payloads, far larger, need no sort.
    held = materialise(payload.join(nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node", "payload"]), "payload")
    pairs = found.where("u is not null").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("lead").alias("lead"))
    pairs = materialise(pairs, "pairs")
    links = verify(_with_payloads(pairs, held)).select("u", "v", "lead")
    grouped = components(links, "lead")
    members = found.where("u is null").select("key", F.col("v").alias("node"), "g", "h")
    member = members.join(grouped, "node", "left").select("key", "node", "g", "h", F.coalesce("component", "node").alias("component"))
    member = materialise(member, "members")
    discard(found)
    late = _rest_in_tasks(member, held, linked) if linked else _rest_by_pairs(member, pairs, close_sql, held, verify, finer)
    if late is not None:
        # Links between components: these are few, and what is inside of them is not looked at again.
        joined = components(late)
        to = joined.select(F.col("node").alias("from"), F.col("component").alias("to"))
        moved = grouped.join(to, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
        lone = joined.join(grouped.select("component").distinct().withColumnRenamed("component", "node"), "node", "left_anti")
        grouped, before = materialise(moved.union(lone), "components"), grouped
        discard(before, joined)
    discard(pairs, member, held)
    return grouped


def _with_payloads(pairs: DataFrame, held: DataFrame) -> DataFrame:
    one = pairs.join(held.select(F.col("node").alias("u"), F.col("payload").alias("a")), "u")
    return one.join(held.select(F.col("node").alias("v"), F.col("payload").alias("b")), "v")


def _largest(member: DataFrame, group: str) -> DataFrame:
    """Groups of more than one component, and the component that most of their items are in."""
    shares = member.groupBy(group, "component").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy(group).agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"))
    return materialise(largest.where("parts > 1").select(group, "largest"), "largest")


def _rest_by_pairs(member: DataFrame, pairs: DataFrame, close_sql, held: DataFrame, verify, finer: Finer | None) -> DataFrame | None:
    """Links ``u``, ``v`` between components, by a table of the pairs that pass the guard."""
    largest = _largest(member, "key")
    if largest.isEmpty():
        return None
    all_of = member.join(largest, "key")
    if finer:
        all_of = all_of.join(finer[0](held), "node")
    all_of = materialise(all_of, "members")
    few = all_of.where("component <> largest").select("key", F.col("node").alias("a"), F.col("g").alias("g2"), F.col("h").alias("h2"), F.col("component").alias("c"), *([F.col("f").alias("f2")] if finer else []))
    near = close_sql(F.col("g"), F.col("h"), F.col("g2"), F.col("h2"))
    if finer:
        near &= finer[1](F.col("g"), F.col("g2"), F.col("f"), F.col("f2"))
    across = few.join(all_of, "key").where((F.col("c") != F.col("component")) & ((F.col("component") == F.col("largest")) | (F.col("a") < F.col("node"))) & near)
    across = across.groupBy(F.least("a", "node").alias("u"), F.greatest("a", "node").alias("v")).agg(F.min(F.least("c", "component")).alias("one"), F.max(F.greatest("c", "component")).alias("two"))
    more = materialise(across.join(pairs, ["u", "v"], "left_anti"), "pairs")
    late = materialise(verify(_with_payloads(more, held)).select(F.col("one").alias("u"), F.col("two").alias("v")).distinct(), "late")
    discard(all_of, more, largest)
    return late


def _rest_in_tasks(member: DataFrame, payload: DataFrame, linked: Linked) -> DataFrame | None:
    """The rest, compared inside tasks: blocks with one first item are one group, cut into tiles.

    ``payload``: ``node`` and what ``linked`` compares. A tile holds up to ``TILE`` items outside
    of the group's largest component and ``TILE`` of all; only one link for each of the former
    and each component it reaches leaves the task, so nothing grows with the pairs. Links are
    given as the components that they join.
    """
    leads = materialise(member.groupBy("key").agg(F.min("node").alias("lead")), "leads")
    rows = led = materialise(member.join(leads, "key").select("lead", "node", "component").distinct(), "led")
    largest = _largest(rows, "lead")
    if largest.isEmpty():
        return None
    rows = rows.join(largest, "lead").withColumn("few", F.col("component") != F.col("largest"))
    sizes = materialise(rows.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("n_all"), F.ceil(F.count_if("few") / TILE).cast("int").alias("n_few")), "sizes")
    rows = materialise(rows.join(sizes, "lead"), "led")
    at = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n).cast("long")).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = rows.where("few").select("lead", "node", "component", F.lit(True).alias("few"), at("n_few").alias("i"), over("n_all").alias("j"))
    asked = rows.select("lead", "node", "component", F.lit(False).alias("few"), at("n_all").alias("j"), over("n_few").alias("i"))
    tiles = asking.unionByName(asked).join(payload, "node")

    def compare(table: pa.Table) -> pa.Table:
        few = table.column("few").to_numpy(zero_copy_only=False)
        node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
        one, two = np.flatnonzero(few), np.flatnonzero(~few)
        if not len(one) or not len(two):
            return pa.table({"u": node[:0], "v": node[:0]})
        content = table.column("payload").combine_chunks()
        hit = linked(content.take(pa.array(one)), content.take(pa.array(two)))
        hit &= component[one][:, None] != component[two][None, :]
        a, b = np.nonzero(hit)
        pair = np.unique(np.stack([component[one[a]], component[two[b]]]), axis=1)
        return pa.table({"u": pair[0], "v": pair[1]})

    late = materialise(tiles.groupBy("lead", "i", "j").applyInArrow(compare, "u long, v long").distinct(), "late")
    discard(rows, sizes, largest, led, leads)
    return late
