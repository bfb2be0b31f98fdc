"""Statistics of the prefix trie of conversations, by balanced parentheses.

A node is a distinct sequence of first turns, known by its depth and two sums over its turns, sum(x_i * B**i) modulo the
prime 2**61 - 1.  Turns are sorted by range and summed within partitions; what a conversation has in earlier partitions is
carried over, so a conversation of any length is spread over tasks.

Nodes with the same smallest member and the same number of members have the same members, so they form a chain without a
fork; chains are the nodes of a compact trie.  Its leaves, each with the chains on its way, are sorted into shards by range.
A shard is written as balanced parentheses: excess over blocks with their minima in a tree delimits each subtree
(findclose), the rank of leaf pairs counts its leaves, and cumulative arrays give its savings.  Chains on the way to a
shard's first or last leaf, its spines, may go on in other shards: they leave it as paths with what hangs off them, and the
spines of all shards, two for each, are merged as one more trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspark.llm.common import materialise, released, small_keys

#: The modulus and the two bases of the sums.
PRIME = (1 << 61) - 1
BASES = (0x0A3C59E5D1B7F2C1 % PRIME, 0x13C6EF372FE94F82 % PRIME)
#: Conversations begin with the first turns of the one whose id is their own rounded down to this; so many turns at most.
ROUND, HEADS = 100, 6
#: Leaves of a shard, about; bytes of ids that leave a task at once; parentheses of a block; rows that may be broadcast.
SHARD, CHUNK, SPAN, FEW = 100_000, 1 << 20, 64, 100_000
U = np.uint64
LOW32 = U(0xFFFFFFFF)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Products modulo the prime, of values below it."""
    b = np.asarray(b, np.uint64)
    ah, al, bh, bl = a >> U(32), a & LOW32, b >> U(32), b & LOW32
    middle, low = al * bh + ah * bl, al * bl
    # 2**64 is 8 and 2**61 is 1 modulo the prime
    return _reduced(((ah * bh) << U(3)) + (middle >> U(29)) + ((middle & U((1 << 29) - 1)) << U(32)) + (low >> U(61)) + (low & U(PRIME)))


def less(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return _reduced(a + (U(PRIME) - np.asarray(b, np.uint64)))


def _running(x: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Sums modulo the prime of each run up to and with each value; ``run`` is the index of a value's first one."""
    halves = []
    for part in (x & LOW32, x >> U(32)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
        halves.append(_reduced(total[1:] - total[run]))
    return _reduced(times(halves[1], 1 << 32) + halves[0])


class _Powers:
    def __init__(self, base: int):
        self.base, self.up = base, np.ones(1, np.uint64)

    def to(self, n: int) -> np.ndarray:
        while len(self.up) < n:
            self.up = np.concatenate((self.up, times(self.up, pow(self.base, len(self.up), PRIME))))
        return self.up


NUMBERED = "part int, conv_id long, pos long, a1 long, a2 long, t1 long, t2 long, chars long, upto long"


@released
def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, print, chars) with their number, terms and sums (also of chars) within this partition's part of the conversation."""
    part = TaskContext.get().partitionId()
    powers = [_Powers(b) for b in BASES]
    now, count, sums, length = None, 0, [0, 0], 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_numpy(zero_copy_only=False)
        halves = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(n, 2)
        chars = b.column(2).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        goes_on = (run == 0) if now is not None and conv[0] == now else np.zeros(n, bool)
        pos = np.arange(n) - run + np.where(goes_on, count, 0)
        total = np.concatenate(([0], np.cumsum(chars)))
        upto = total[1:] - total[run] + np.where(goes_on, length, 0)
        out = []
        for k in range(2):
            term = times(_reduced(halves[:, k]), powers[k].to(int(pos.max()) + 1)[pos])
            out.append((_reduced(_running(term, run) + np.where(goes_on, U(sums[k]), U(0))), term))
        now, count, length, sums = conv[-1], int(pos[-1]) + 1, int(upto[-1]), [int(out[k][0][-1]) for k in range(2)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), b.column(0), pa.array(pos), *(pa.array(out[k][j].astype(np.int64)) for j in range(2) for k in range(2)), b.column(2), pa.array(upto)], names=[c.split()[0] for c in NUMBERED.split(", ")]
        )


def _carries(parts: list) -> dict[int, tuple]:
    """What the conversation that a partition begins with has in earlier ones: (conv_id, turns, sums, chars) by partition."""
    carry, held = {}, None
    for p in sorted(parts, key=lambda r: r.part):
        last = (p.last.conv_id, p.last.pos + 1, p.last.a1, p.last.a2, p.last.upto)
        if held and p.first == held[0]:
            carry[p.part] = held
            if last[0] == held[0]:
                last = (held[0], held[1] + last[1], *((held[2 + k] + pow(BASES[k], held[1], PRIME) * last[2 + k]) % PRIME for k in range(2)), held[4] + last[4])
        held = last
    return carry


def _carried(carry: dict[int, tuple]):
    @released
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            cols = [b.column(k).to_numpy(zero_copy_only=False).copy() for k in range(2, 9)]
            for p in np.unique(part):
                if int(p) in carry:
                    c, n, s1, s2, length = carry[int(p)]
                    at = (part == p) & (conv == c)
                    cols[0][at] += n
                    cols[6][at] += length
                    for k, s in enumerate((s1, s2)):
                        shift = pow(BASES[k], n, PRIME)
                        cols[1 + k][at] = _reduced(times(cols[1 + k][at].astype(np.uint64), shift) + U(s)).astype(np.int64)
                        cols[3 + k][at] = times(cols[3 + k][at].astype(np.uint64), shift).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in cols)], names=b.schema.names)

    return add


def number_turns(conversations: DataFrame) -> DataFrame:
    """Turns by conversation in order of turn (null first), then of their print: number, sums up to each, and lengths."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    prints = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", prints.alias("print"), F.char_length(text).cast("long").alias("chars"))
    dealt = turns.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "print").sortWithinPartitions("conv_id", "turn", "print")
    numbered = materialise(dealt.select("conv_id", "print", "chars").mapInArrow(_numbered, NUMBERED), "numbered-turns")
    last = F.struct("conv_id", "pos", "a1", "a2", "upto")
    # a row for each partition
    carry = _carries(numbered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max_by(last, F.struct("conv_id", "pos")).alias("last")).collect())
    return numbered.mapInArrow(_carried(carry), NUMBERED) if carry else numbered


KEYED = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, upto long, last boolean"


@released
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns with what comes before them to nodes and their parents: a shorter head moves the turns by a power of the base."""
    back = [np.array([pow(b, -k, PRIME) for k in range(HEADS)], np.uint64) for b in BASES]
    for b in batches:
        col = {name: b.column(name).to_numpy(zero_copy_only=False) for name in ("moved", "a1", "a2", "t1", "t2", "b1", "b2", "o1", "o2")}
        keys, ups = [], []
        for k in range(2):
            shift = back[k][col["moved"]]
            a, t, o, before = (col[f"{x}{k + 1}"].astype(np.uint64) for x in "atob")
            key = _reduced(before + times(less(a, o), shift))
            keys.append(pa.array(key.astype(np.int64)))
            ups.append(pa.array(less(key, times(t, shift)).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("depth"), *keys, *ups, b.column("chars"), b.column("upto"), b.column("last")], names=[c.split()[0] for c in KEYED.split(", ")])


def rebuilt_nodes(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each conversation and each node on its way, from the root (depth 0, keys 0) on; ``last`` marks its end.

    Conversations are rebuilt: the first crc32(id) % ``HEADS`` turns are those of the conversation whose id is theirs rounded
    down to ``ROUND``; with ``whole`` they stay as they are.
    """
    turns = number_turns(conversations)
    head = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "a1", "a2", "t1", "t2", "chars", "upto"))
    convs = materialise(turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), F.array_sort(F.collect_list(head)).alias("head")), "conversations")
    h = F.lit(0).cast("long") if whole else F.crc32(F.col("conv_id").cast("string")) % HEADS
    bases = convs.filter(F.col("conv_id") % ROUND == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    info = convs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % ROUND).join(small_keys(bases, FEW), "base", "left")
    info = info.withColumn("g", F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))).withColumn("g", F.greatest("g", F.lit(0)))
    zero = F.lit(0).cast("long")
    before, own = (F.when(F.col(c) > 0, F.get(head, F.col(c) - 1)) for c, head in (("g", F.col("base_head")), ("h", F.col("head"))))
    # own turns count from the h-th on; where a conversation has fewer, it has none of its own
    info = info.select(
        "conv_id", "n", "h", "g", "base_head",
        *(F.coalesce(before[a], zero).alias(f"b{k}") for k, a in enumerate(("a1", "a2", "upto"), 1)),
        *(F.coalesce(own[a], zero).alias(f"o{k}") for k, a in enumerate(("a1", "a2", "upto"), 1)),
    )
    info = materialise(info, "heads")
    of = small_keys(info.drop("base_head"), FEW)
    owned = turns.drop("part").join(of, "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("g") + F.col("pos") - F.col("h") + 1).alias("depth"), (F.col("h") - F.col("g")).alias("moved"), "a1", "a2", "t1", "t2", "b1", "b2", "o1", "o2", "chars",
        (F.col("b3") + F.col("upto") - F.col("o3")).alias("upto"), (F.col("pos") == F.col("n") - 1).alias("last"),
    ).mapInArrow(_keyed, KEYED)
    lent = info.filter("g > 0").select("conv_id", "n", "h", "g", F.explode(F.slice("base_head", 1, F.col("g"))).alias("x")).select(
        "conv_id", (F.col("x.pos") + 1).alias("depth"), "x.a1", "x.a2", F.pmod(F.col("x.a1") - F.col("x.t1"), F.lit(PRIME)), F.pmod(F.col("x.a2") - F.col("x.t2"), F.lit(PRIME)), "x.chars", "x.upto",
        ((F.col("n") <= F.col("h")) & (F.col("x.pos") == F.col("g") - 1)),
    )
    root = info.select("conv_id", zero, zero, zero, zero, zero, zero, zero, (F.col("n") <= F.col("h")) & (F.col("g") == 0))
    return materialise(owned.union(lent).union(root), "turns-of-nodes")


SHARDS = "conv long, n long, leaves long, total long, path array<struct<conv: long, n: long, saves: long, leaves: long, total: long>>"
STEP = pa.struct([(x, pa.int64()) for x in ("conv", "n", "saves", "leaves", "total")])


class Parentheses:
    """A forest as balanced parentheses, from the depths of its nodes in preorder; blocks of excess with a tree of minima."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.open = 2 * np.arange(n) - depth
        step = np.full(2 * n, -1, np.int32)
        step[self.open] = 1
        self.leaf = np.concatenate(([0], np.cumsum((step[:-1] == 1) & (step[1:] == -1)))) if n else np.zeros(1, np.int64)  # leaf pairs that begin before a place
        blocks = max(1, -(-2 * n // SPAN))
        self.size = 1 << (blocks - 1).bit_length()
        self.excess = np.full(self.size * SPAN, np.iinfo(np.int32).max, np.int32)
        self.excess[: 2 * n] = np.cumsum(step)
        self.excess = self.excess.reshape(self.size, SPAN)
        self.least = np.concatenate((np.zeros(self.size, np.int32), self.excess.min(axis=1)))
        for k in range(self.size - 1, 0, -1):
            self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])

    def close(self, at: np.ndarray) -> np.ndarray:
        """The place of the parenthesis that closes each of the open ones at ``at``: the first one after it with less excess."""
        out = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 15):
            out[i : i + (1 << 15)] = self._close(at[i : i + (1 << 15)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        block, off = at // SPAN, at % SPAN
        value = self.excess[block, off]
        later = (self.excess[block] < value[:, None]) & (np.arange(SPAN) > off[:, None])
        here = later.any(axis=1)
        out = block * SPAN + later.argmax(axis=1)
        far = np.flatnonzero(~here)
        if len(far):
            node, value = self.size + block[far], value[far]
            found = np.zeros(len(far), bool)
            while not found.all():  # up, until the right sibling has less
                right = (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.size - 1)] < value)
                node = np.where(found, node, np.where(right, node + 1, node >> 1))
                found |= right
            while node[0] < self.size or (node < self.size).any():  # down, to the first block with less
                inner = node < self.size
                left = self.least[np.minimum(2 * node, 2 * self.size - 1)] < value
                node = np.where(inner, 2 * node + ~left, node)
            block = node - self.size
            out[far] = block * SPAN + (self.excess[block] < value[:, None]).argmax(axis=1)
        return out


def _shard(last: bool):
    """Sorted leaf paths of a shard to results of its nodes, and its two spines as paths; with ``last`` there is but one shard."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0) for b in batches if b.num_rows]
        if not held:
            return
        paths = pa.chunked_array(held).combine_chunks()
        offsets = paths.offsets.to_numpy()
        steps = paths.flatten()
        conv, n, saves, hung, owed = (steps.field(k).to_numpy(zero_copy_only=False) for k in range(5))
        offsets = offsets - offsets[0]
        level = np.arange(len(conv)) - np.repeat(offsets[:-1], np.diff(offsets))
        # nodes in preorder: in the order in which they occur first
        both = np.stack([conv, n], axis=1)
        _, first, back = np.unique(both, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        node, at = place[back.ravel()], first[order]
        m = len(at)
        saves, leaves, total = saves[at].astype(np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        np.add.at(leaves, node, hung)
        np.add.at(total, node, owed)
        trie = Parentheses(level[at])
        close = trie.close(trie.open)
        end = np.arange(m) + (close - trie.open + 1) // 2
        pairs = np.concatenate((trie.leaf, trie.leaf[-1:]))
        spine = np.zeros(m, bool)
        if not last:
            spine[node[: offsets[1]]] = spine[node[offsets[-2] :]] = True
        # what belongs to no spine, or everything
        off = ~spine
        ends_here = pairs[trie.open + 1] > pairs[trie.open]
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (leaves + (off & ends_here if not last else 0), total + np.where(off, saves, 0))]
        below = [s[end] - s[: m] for s in sums]
        if last:
            below[0] = below[0] + pairs[close] - pairs[trie.open]
        done = np.flatnonzero(off)
        none = pa.nulls(len(done), pa.list_(STEP))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[done]) for x in (conv[at], n[at], below[0], below[1])), none], names=["conv", "n", "leaves", "total", "path"])
        if last:
            return
        out, told = [], set()
        ways = [node[: offsets[1]].tolist(), node[offsets[-2] :].tolist()]
        hang = {}
        for way in ways:
            for k in way:
                hang[k] = [int(below[0][k]), int(below[1][k])]
        for child, up in {(c, u) for way in ways for u, c in zip(way, way[1:], strict=False)}:
            for x in range(2):
                hang[up][x] -= int(below[x][child])
        for way in ways if ways[0] != ways[1] else ways[:1]:
            out.append([{"conv": int(conv[at[k]]), "n": int(n[at[k]]), "saves": int(saves[k]), "leaves": 0 if k in told else hang[k][0], "total": 0 if k in told else hang[k][1]} for k in way])
            told.update(way)
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(out, pa.list_(STEP))], names=["conv", "n", "leaves", "total", "path"])

    return count


def subtree_sums(leaf_paths: DataFrame) -> DataFrame:
    """(conv, n, leaves, total) of every chain on the ``leaf_paths`` (path: array of SHARDS' steps, from the root on)."""
    spark, key = leaf_paths.sparkSession, F.transform("path", lambda x: x["conv"]).alias("key")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaf_paths.count() // SHARD))
    dealt = leaf_paths.select("path", key).repartitionByRange(n, "key").sortWithinPartitions("key").select("path")
    shards = materialise(dealt.mapInArrow(_shard(False), SHARDS), "shards")
    # two rows for each shard
    spines = shards.filter("path IS NOT NULL").select("path", key).repartition(1).sortWithinPartitions("key").select("path").mapInArrow(_shard(True), SHARDS)
    return shards.filter("path IS NULL").union(spines).select("conv", "n", "leaves", "total")


IDS = "depth long, k1 long, k2 long, first long, ids string, ends_sha256 string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
    """((depth, k1, k2), number of the run, first row of the run or not, ids) piece by piece of sorted ends."""
    now, k = None, -1
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
        ids = b.column(3).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for i, j in zip(cut, cut[1:], strict=False):
            key = tuple(keys[i].tolist())
            k += key != now
            yield key, k, key != now, ids[i:j]
            now = key


@released
def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends to digests of the nodes inside this partition, and to pieces of the ids of its first and its last node."""
    rows: list[tuple] = []
    held, now, run = 0, None, -1
    parts, size, first, cut = [], 0, None, False

    def piece() -> tuple:
        return (*now, first, ",".join(parts), None)

    for key, k, new, ids in _runs(batches):
        if new:
            if parts:  # inside the partition a node is complete when the next one begins
                rows.append(piece() if cut or run == 0 else (*now, None, None, hashlib.sha256(",".join(parts).encode()).hexdigest()))
                held += size
            now, run, parts, size, first, cut = key, k, [], 0, None, False
        for i in range(0, len(ids), 1 << 14):
            first = int(ids[i]) if first is None else first
            parts.append(",".join(map(str, ids[i : i + (1 << 14)].tolist())))
            size += len(parts[-1])
            if size >= CHUNK:
                rows.append(piece())
                held += size
                parts, size, first, cut = [], 0, None, True
        if held >= CHUNK or len(rows) >= 1 << 14:
            yield _id_rows(rows)
            rows, held = [], 0
    if parts:
        rows.append(piece())
    if rows:
        yield _id_rows(rows)


def _id_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds, names = [pa.int64()] * 4 + [pa.string()] * 2, [c.split()[0] for c in IDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@released
def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of ids to digests; a piece at a time is held."""
    names, rows, now, digest = ["depth", "k1", "k2", "ends_sha256"], [], None, None
    for b in batches:
        for *key, _, ids in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if key != now:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if now is not None:
        rows.append((*now, digest.hexdigest()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if c == 3 else pa.int64()) for c, x in enumerate(zip(*rows, strict=True))], names=names)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of the ids of the conversations that end at a node, in order, with commas.

    Ends are sorted by range of node and id.  A node inside a partition is done there; one that reaches over its edge, or
    that has very many ids, leaves as pieces of text, which are streamed through one hash in order (a digest is sequential).
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("depth", "k1", "k2", "conv_id")
    rows = materialise(ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_written, IDS), "ends")
    pieces = rows.filter("ids IS NOT NULL").select("depth", "k1", "k2", "first", "ids").repartition(n, "depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "first")
    return rows.filter("ids IS NULL").select("depth", "k1", "k2", "ends_sha256").union(pieces.mapInArrow(_streamed, "depth long, k1 long, k2 long, ends_sha256 string"))


def trie_nodes(conversations: DataFrame, whole: bool = False) -> DataFrame:
    """One row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Turns are ordered by turn (null first); turns of one number, which may repeat, by the MD5 of role and text.  A null role
    or text is empty.  Rows without a conv_id belong to no conversation and are ignored.  A conversation without turns after
    it was rebuilt ends at the root.  An empty table gives no rows; other columns are not read.
    """
    rows = rebuilt_nodes(conversations, whole)
    nodes = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("p1", "p2", "chars", "upto")))
    nodes = materialise(nodes, "nodes")
    chains = nodes.groupBy("conv", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min_by(F.struct("p1", "p2"), "depth").alias("up"), F.max_by(F.struct("k1", "k2"), "depth").alias("low"),
        F.max("upto").alias("end_chars"), F.min(F.col("upto") - F.col("chars")).alias("top_chars"),
    )
    chains = materialise(chains.select("conv", "n", "top", "bottom", "up.p1", "up.p2", "low.k1", "low.k2", "end_chars", "top_chars", ((F.col("n") - 1) * (F.col("end_chars") - F.col("top_chars"))).alias("saves")), "chains")
    # forks: chains of several members, by the node at their end
    forks = chains.filter("n > 1").select(F.col("bottom").alias("f0"), F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("conv").alias("up_conv"), F.col("n").alias("up_n"), "saves")
    above = (F.col("top") - 1 == F.col("f0")) & (F.col("p1") == F.col("f1")) & (F.col("p2") == F.col("f2"))
    tree = chains.join(small_keys(forks.drop("saves"), FEW), above, "left").drop("f0", "f1", "f2", "p1", "p2")
    tree = materialise(tree, "tree")
    children = tree.filter("up_conv IS NOT NULL").groupBy("up_conv", "up_n").agg(F.count(F.lit(1)).alias("n_children"))
    tree = materialise(tree.join(small_keys(children.withColumnsRenamed({"up_conv": "conv", "up_n": "_n"}), FEW).withColumnRenamed("_n", "n"), ["conv", "n"], "left"), "counted")

    leaves = tree.filter("n_children IS NULL").select("conv", "n", "saves")
    none = F.lit(0).cast("long")
    step = F.struct(F.col("up_conv").alias("conv"), F.col("up_n").alias("n"), "saves", none.alias("leaves"), none.alias("total"))
    at_fork = (F.col("depth") == F.col("f0")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))
    passed = rows.select("conv_id", "depth", "k1", "k2").join(small_keys(forks, FEW), at_fork)
    passed = passed.join(small_keys(leaves.select(F.col("conv").alias("conv_id")), FEW), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", step.alias("s")))).alias("way"))
    own = F.when(F.col("n") == 1, F.array(F.struct("conv", "n", "saves", none.alias("leaves"), none.alias("total")))).otherwise(F.array().cast(SHARDS.rpartition(", path ")[2]))
    way = F.coalesce(F.transform("way", lambda x: x["s"]), F.array().cast(SHARDS.rpartition(", path ")[2]))
    paths = materialise(leaves.join(passed.withColumnRenamed("conv_id", "conv"), "conv", "left").select(F.concat(way, own).alias("path")), "paths")
    sums = subtree_sums(paths)

    ends = end_digests(rows.filter("last").select("conv_id", "depth", "k1", "k2"))
    ended = F.col("bottom") == F.col("depth")
    tree = tree.join(ends.withColumnsRenamed({"k1": "e1", "k2": "e2"}), ended & (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left").drop("depth", "e1", "e2", "k1", "k2", "saves")
    tree = materialise(tree.join(sums, ["conv", "n"]), "summed")
    low = F.col("depth") == F.col("bottom")
    return nodes.select("conv", "n", "depth", "chars", "upto").join(small_keys(tree, FEW), ["conv", "n"]).select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == F.col("top"), F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(low, F.coalesce("n_children", none)).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - (F.col("n") - 1) * (F.col("upto") - F.col("chars") - F.col("top_chars"))).alias("saved_tokens"),
        F.when(low, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
