"""Merkle manifest of a table: a tree of SHA-256 digests whose parents keep their hash states.

A leaf is the digest of a row's fields. Per group (a language), leaves ascend by id; every
``arity`` consecutive nodes become the digest of their hex digests, level by level, until one
is left, the subroot. The subroots in group order give the root in the same way.

A hex digest is 64 bytes, one SHA-256 block, so the state of a parent's hash between two
children is eight words. The tree stores it before each child slot. A changed leaf is folded
to the root by resuming the stored state of its slot with the new digest and then the right
siblings only; left siblings are never hashed again.

Leaves are numbered by one range-partitioned sort and per-partition counts. ``DEPTH`` levels
are built at once, from blocks of ``arity ** DEPTH`` consecutive nodes, one table row each; the
block roots are the nodes of the next tier. So a tier needs one shuffle, no group is ever
gathered, and rows above the first tier are 256 times fewer. Every tier is stored.

Cases: null fields are hashed as ``-``; a null group is a group of its own and comes first;
null ids come first within their group; rows of equal id ascend by leaf digest, and equal
leaves are interchangeable; repeated rows are leaves of their own; an empty table gives no rows
and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from paneltide.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
DEPTH = 8
LANES = 4096  # digests hashed together, so that they stay in the cache


def _cube_root(x: int) -> int:
    r = int(round(x ** (1 / 3)))
    while r**3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


# SHA-256 takes its constants from the roots of the first 64 primes
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
_ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _PRIMES], np.uint32)
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)
_HEX = np.frombuffer("".join(f"{k:02x}" for k in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) each."""
    n = state.shape[1]
    if n > LANES:
        return np.concatenate([absorb(state[:, k : k + LANES], block[:, k : k + LANES]) for k in range(0, n, LANES)], 1)
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            low = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
            high = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
            w.append(w[t - 16] + low + w[t - 7] + high)
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as text, in words (16, n)."""
    return _HEX[digests].reshape(-1, 64).view(">u4").T.astype(np.uint32)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of states that have absorbed so many hex digests."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0] = 0x80000000
    block[15] = children * 512
    return to_bytes(absorb(state, block))


def to_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8)


def to_state(data: np.ndarray) -> np.ndarray:
    """The reverse: stored states (n, 32) as words (8, n)."""
    return np.ascontiguousarray(data).view(">u4").T.astype(np.uint32)


def parents(nodes: np.ndarray, local: np.ndarray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests (p, 32) of the runs of ``arity`` nodes, and the states (p, arity, 32) before each child slot.

    ``local`` is each node's number in its block, counted from 0 and without gaps.
    """
    first = np.flatnonzero(local % arity == 0)
    size = np.diff(np.append(first, len(nodes)))
    state = np.repeat(START[:, None], len(first), 1)
    before = np.zeros((len(first), arity, 32), np.uint8)
    for slot in range(arity):
        has = np.flatnonzero(size > slot)
        before[has, slot] = to_bytes(state[:, has])
        state[:, has] = absorb(state[:, has], hex_block(nodes[first[has] + slot]))
    return finish(state, size), before


def _joined(column: pa.Array) -> np.ndarray:
    """Binary values of 32 bytes each, or multiples, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each block."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _grow(arity: int, depth: int):
    span = arity**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column("total").to_numpy()
            held = batch.column("digests")
            nodes, sizes = _joined(held.flatten()), np.diff(held.offsets.to_numpy())
            levels: list[list[bytes]] = [[] for _ in total]
            states: list[list[bytes]] = [[] for _ in total]
            roots: list[bytes] = [b""] * len(total)
            blocks, left = np.arange(len(total)), np.full(len(total), depth)
            for level in range(depth + 1):
                edges = np.concatenate([[0], np.cumsum(sizes)])
                for k, b in enumerate(blocks):
                    levels[b].append(nodes[edges[k] : edges[k + 1]].tobytes())
                # the only block of its group ends at one node, all others after ``depth`` levels
                done = (left == 0) | ((sizes == 1) & (total[blocks] <= span))
                for k in np.flatnonzero(done):
                    roots[blocks[k]] = levels[blocks[k]][-1]
                nodes, blocks, sizes, left = nodes[np.repeat(~done, sizes)], blocks[~done], sizes[~done], left[~done]
                if not len(blocks):
                    break
                nodes, before = parents(nodes, _counted(sizes), arity)
                sizes, left = -(-sizes // arity), left - 1
                edges = np.concatenate([[0], np.cumsum(sizes)])
                for k, b in enumerate(blocks):
                    states[b].append(before[edges[k] : edges[k + 1]].tobytes())
            binaries = pa.list_(pa.binary())
            columns = [pa.array(levels, binaries), pa.array(states, binaries), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("block"), batch.column("kids"), *columns],
                names=["group", "block", "kids", "nodes", "states", "digest"],
            )

    return run


def _level(batch: pa.RecordBatch, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some blocks, one after the other: the nodes of level k, their number per block, and the states above them."""
    nodes, states = batch.column("nodes"), batch.column("states")
    held = [nodes[int(r)].values[k].as_py() for r in rows]
    above = b"".join([states[int(r)].values[k].as_py() for r in rows])
    return (
        np.frombuffer(b"".join(held), np.uint8).reshape(-1, 32),
        np.array([len(x) // 32 for x in held]),
        np.frombuffer(above, np.uint8).reshape(-1, 32),
    )


def _steps(batch: pa.RecordBatch, arity: int) -> Iterator[tuple]:
    """Per level of the blocks of a batch, for their leaves that it concerns: the way of each up to its parent.

    (leaves, state before the slot, child count, nodes, first node of the run, slot)
    """
    sizes = np.diff(batch.column("kids").offsets.to_numpy())
    height = np.array([len(x) for x in batch.column("states")])
    owner, local = np.repeat(np.arange(len(sizes)), sizes), _counted(sizes)
    for k in range(int(height.max(initial=0))):
        rows = np.flatnonzero(height > k)
        nodes, count, states = _level(batch, rows, k)
        runs = -(-count // arity)
        place = np.zeros(len(sizes), np.int64)
        place[rows] = np.arange(len(rows))
        leaves = np.flatnonzero(height[owner] > k)
        b = place[owner[leaves]]
        here = local[leaves] // arity**k
        slot = here % arity
        first = (np.cumsum(count) - count)[b] + here - slot
        above = (np.cumsum(runs) - runs)[b] + here // arity
        yield leaves, states[above * arity + slot], np.minimum(arity, count[b] - here + slot), nodes, first, slot


_STEP = pa.struct([("before", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
_PATH = ArrayType(StructType([StructField(x, BinaryType()) for x in ("before", "left", "right")]))


def _paths(arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kids = batch.column("kids")
            sizes = np.diff(kids.offsets.to_numpy())
            ways: list[list[dict]] = [[] for _ in range(sizes.sum())]
            for leaves, before, count, nodes, first, slot in _steps(batch, arity):
                for i, state, n, f, s in zip(leaves, before, count, first, slot):
                    ways[i].append({"before": state.tobytes(), "left": nodes[f : f + s].tobytes(), "right": nodes[f + s + 1 : f + n].tobytes()})
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(owner) for c in ("group", "block", "digest")), kids.flatten(), pa.array(ways, pa.list_(_STEP))],
                names=["group", "block", "top", "kid", "path"],
            )

    return run


def _resume(state: np.ndarray, digest: np.ndarray, count: np.ndarray, slot: np.ndarray, right) -> np.ndarray:
    """Parent digests: the state before a slot, then a digest, then the right siblings ``right(which, slots after it)``."""
    state = absorb(to_state(state), hex_block(digest))
    for more in range(1, int((count - slot).max(initial=1))):
        has = np.flatnonzero(slot + more < count)
        state[:, has] = absorb(state[:, has], hex_block(right(has, more)))
    return finish(state, count)


def _prove(arity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kids, path = batch.column("kids"), batch.column("path").to_pylist()
            sizes = np.diff(kids.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            kid = kids.flatten()
            now = _joined(kid.field("fresh")).copy()
            proofs: list[list[bytes]] = [[] for _ in owner]
            for leaves, before, count, nodes, first, slot in _steps(batch, arity):
                now[leaves] = _resume(before, now[leaves], count, slot, lambda has, more: nodes[first[has] + slot[has] + more])
                for s in range(arity):
                    has = np.flatnonzero((s < count) & (s != slot))
                    for i, sibling in zip(leaves[has], nodes[first[has] + s]):
                        proofs[i].append(sibling.tobytes())
            for k in range(max(map(len, path), default=0)):  # above the block, where its leaves share one way
                rows = [r for r in range(len(path)) if len(path[r]) > k]
                at = np.full(len(path), -1)
                at[rows] = np.arange(len(rows))
                leaves = np.flatnonzero(at[owner] >= 0)
                which = at[owner[leaves]]
                before = np.frombuffer(b"".join(path[r][k]["before"] for r in rows), np.uint8).reshape(-1, 32)
                slot = np.array([len(path[r][k]["left"]) // 32 for r in rows])
                rest = np.array([len(path[r][k]["right"]) // 32 for r in rows])
                right = np.frombuffer(b"".join(path[r][k]["right"] for r in rows), np.uint8).reshape(-1, 32)
                start = np.cumsum(rest) - rest
                count = (slot + rest + 1)[which]
                now[leaves] = _resume(before[which], now[leaves], count, slot[which], lambda has, more: right[start[which[has]] + more - 1])
            ends = [b"".join(step["left"] + step["right"] for step in p) for p in path]
            proof = [b"".join(p) + ends[o] for p, o in zip(proofs, owner)]
            tops = [batch.column(c).take(pa.array(owner)) for c in ("subroot", "root")]
            yield pa.RecordBatch.from_arrays(
                [kid.field("row"), kid.field("digest"), *tops, pa.array(proof, pa.binary()), pa.array([x.tobytes() for x in now], pa.binary())],
                names=["row", "leaf", "subroot", "root", "siblings", "folded"],
            )

    return run


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their number within ``group`` in the order ``by``, and ``total``, the group's rows; stored.

    One range-partitioned sort, also within a group; of the partitions only counts are
    exchanged. ``spot`` spreads rows that are equal in all of ``by`` over partitions.
    """
    keys = ["group", *by, "spot"]
    ranged = rows.withColumn("spot", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("spot"))
    parts = held.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("group", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    placed = held.join(cut(parts), ["group", "part"])
    return placed.withColumn("pos", F.col("at") - F.col("first") + F.col("offset")).drop("at", "part", "first", "offset")


def _tier(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """Blocks (group, block, kids, nodes, states, digest) of nodes (group, pos, total, kid), kid a struct that starts with pos and digest."""
    span = arity**depth
    blocks = nodes.groupBy("group", F.floor(F.col("pos") / span).alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list("kid")).alias("kids")  # at most ``span`` of them
    )
    blocks = blocks.withColumn("digests", F.transform("kids", lambda x: x["digest"]))
    binaries = ArrayType(BinaryType())
    schema = StructType(
        [*(blocks.schema[c] for c in ("group", "block", "kids")), StructField("nodes", binaries), StructField("states", binaries), StructField("digest", BinaryType())]
    )
    return cut(blocks.mapInArrow(_grow(arity, depth), schema))


@dataclass
class Tree:
    """Stored tiers of a tree: blocks of nodes with the digests of all their levels and the states before each child slot."""

    tiers: list[DataFrame]
    arity: int
    depth: int

    def roots(self) -> DataFrame:
        """(group, digest): the last tier has one block per group."""
        return self.tiers[-1].select("group", "digest")

    def ways(self, tier: int) -> DataFrame:
        """(group, pos, kid, path, top) of each node that enters a tier: its way to the root of its group."""
        blocks = self.tiers[tier]
        schema = StructType(
            [*(blocks.schema[c] for c in ("group", "block")), StructField("top", BinaryType()), StructField("kid", blocks.schema["kids"].dataType.elementType), StructField("path", _PATH)]
        )
        own = blocks.mapInArrow(_paths(self.arity), schema).withColumn("pos", F.col("kid.pos"))
        if tier + 1 < len(self.tiers):
            above = self.ways(tier + 1).select("group", F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("top").alias("last"))
            own = own.join(above, ["group", "block"]).withColumns({"path": F.concat("path", "rest"), "top": F.col("last")})
        return own.select("group", "pos", "kid", "path", "top")


def build(leaves: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> Tree:
    """The tree of leaves (group, pos, total, kid)."""
    span = arity**depth
    most = leaves.agg(F.max("total")).first()[0] or 1
    tiers = [_tier(leaves, arity, depth)]
    while most > span:
        most = -(-most // span)
        last = tiers[-1]
        totals = last.groupBy("group").agg(F.count(F.lit(1)).alias("total"))
        kid = F.struct(F.col("block").alias("pos"), "digest").alias("kid")
        tiers.append(_tier(last.select("group", F.col("block").alias("pos"), kid).join(totals, "group"), arity, depth))
    return Tree(tiers, arity, depth)


@dataclass
class Manifest:
    """``trees``: one of the leaves of each group, and one of the groups' subroots."""

    leaves: Tree
    groups: Tree

    def root(self) -> DataFrame:
        """(root): one row, none if the table is empty."""
        return self.groups.roots().select(F.lower(F.hex("digest")).alias("root"))

    def prove(self) -> DataFrame:
        """(row, leaf, subroot, root, siblings, folded) per leaf, as bytes.

        ``siblings`` are the other nodes of the runs on the way to the root, left to right,
        32 bytes each; ``folded`` is the root that follows from ``fresh`` and these siblings.
        """
        blocks = self.leaves.tiers[0]
        if len(self.leaves.tiers) > 1:
            above = self.leaves.ways(1).select("group", F.col("pos").alias("block"), "path", F.col("top").alias("subroot"))
            blocks = blocks.join(above, ["group", "block"])
        else:
            blocks = blocks.withColumns({"path": F.array().cast(_PATH), "subroot": F.col("digest")})
        last = self.groups.ways(0).select(F.col("kid.of").alias("group"), F.col("path").alias("rest"), F.col("top").alias("root"))
        whole = blocks.join(cut(last), "group").withColumn("path", F.concat("path", "rest"))
        kid = blocks.schema["kids"].dataType.elementType
        binary = [StructField(x, BinaryType()) for x in ("leaf", "subroot", "root", "siblings", "folded")]
        rows = whole.select("kids", "nodes", "states", "path", "subroot", "root")
        return rows.mapInArrow(_prove(self.leaves.arity), StructType([kid["row"], *binary]))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    carry: list[str] | None = None,
    changed: dict[str, Column] | None = None,
    arity: int = ARITY,
    depth: int = DEPTH,
) -> Manifest:
    """Build and store the tree of a table.

    ``carry`` names the columns that come back with each proof. ``changed`` gives fields other
    values, by which ``Manifest.prove`` folds; without it the fold repeats the root.
    """
    if arity < 2 or depth < 1:
        raise ValueError("a tree needs an arity of two or more and at least one level per tier")
    values = {c: F.col(f"`{c}`") for c in fields}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("group"),
        F.col(f"`{order}`").alias("order"),
        leaf(list(values.values())).alias("digest"),
        leaf(list((values | (changed or {})).values())).alias("fresh") if changed else F.lit(None).cast("binary").alias("fresh"),
        F.struct(*[F.col(f"`{c}`") for c in carry or [order]]).alias("row"),
    )
    leaves = numbered(rows.withColumn("fresh", F.coalesce("fresh", "digest")), ["order", "digest"])
    own = build(leaves.select("group", "pos", "total", F.struct("pos", "digest", "fresh", "row").alias("kid")), arity, depth)
    tops = numbered(own.roots().select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), ["of"])
    return Manifest(own, build(tops.select("group", "pos", "total", F.struct("pos", "digest", "of").alias("kid")), arity, depth))
