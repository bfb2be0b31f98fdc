"""Near duplicates by a join of parity sketches of word shingles.

A document is the set of its 5-word shingles.  Shingles are dealt into blocks by the top bits of their hash, more blocks
for larger sets, and the hashes of a block are XORed: 64 parity bits for each block.  If two sets' Jaccard similarity is at
least 3/4, their symmetric difference is at most a seventh of their sizes' sum, D; each differing shingle spoils one block
at most, so the sets agree in all but D of their non-empty blocks, and, by the pigeonhole principle, in one of the first
D + 1 blocks in any order that all documents share.  These blocks' parities, within a band of sizes, are the join keys.
Blocks of shingles that are frequent everywhere come last in the order.

Before pairs are compared in full, a 512-bit parity sketch of the whole set rejects those whose Hamming distance, which
never exceeds the symmetric difference, is above D.  A group of copies is not expanded into pairs: a first round compares
each document with the leader it shares most keys with and joins what links into components; further rounds try one pair
for every two components that meet in a key, and relabel; the last one compares, within each key, whatever documents are
still in different components.  No link that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landspark.llm.common import WORD_POWERS, discard, groups_of, materialise, mix, released, small_keys, text_buffer, word_hashes
from landspark.llm.graph import components

SHINGLE = 5
#: Shingles, or keys, that a task gathers before it counts them and goes on.
FLUSH = 2_500_000
#: A shingle is frequent if this many documents of one such batch, or more, hold it; the most frequent ones are kept.
OFTEN, OFTEN_KEPT = 4, 500_000
SKETCH = 8  # words of 64 bits
#: Keys before a shared one that tell it is not a pair's first.
BEFORE = 3
#: Rounds at most in which neighbours are tried before all pairs that are left, and documents of a key in one order.
ROUNDS, SPLIT = 8, 256
U = np.uint64
#: Largest set of the first band, and of each further band; within a band all sets have the same number of blocks.
FIRST, SECOND = 64, 256


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs in order, of back-to-back texts."""
    n = len(offsets) - 1
    h, _, _, doc = word_hashes(data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32), offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    WORD_POWERS.grow(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * WORD_POWERS.up[: len(h)], out=total[1:])
    words = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(words)[:-1]))
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    begins = np.flatnonzero(doc[: len(doc) - SHINGLE + 1] == doc[SHINGLE - 1 :]) if len(doc) >= SHINGLE else np.zeros(0, np.int64)
    a = np.concatenate([begins, first[short]])
    z = np.concatenate([begins + SHINGLE, first[short] + words[short]])
    of = doc[a]
    s = mix((total[z] - total[a]) * WORD_POWERS.down[a] + (z - a).astype(np.uint64))
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (of[1:] != of[:-1]) | (s[1:] != s[:-1])
    return of[new], s[new]


def band(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the block number and the largest size, of the band of each set size."""
    over = np.maximum(m, 1) - 1
    up = np.where(m <= SECOND, 8, np.floor(np.log2(np.maximum(over, 1))).astype(np.int64) + 1)
    return np.where(m <= FIRST, 20, up - 1), np.where(m <= FIRST, FIRST, np.int64(1) << up)


SETS = "doc_id long, n long, x long, y long, token long, often long"


@released
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document: size and 128-bit fingerprint of its set; and rows of tokens that are frequent in a batch."""
    names = [c.split()[0] for c in SETS.split(", ")]
    tokens, held = [], 0

    def frequent() -> pa.RecordBatch:
        found, count = np.unique(np.concatenate(tokens), return_counts=True)
        found, count = found[count >= OFTEN], count[count >= OFTEN]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(found.view(np.int64)), pa.array(count)], names=names)

    for b in batches:
        data, offsets = text_buffer(b.column(1))
        for i, j in groups_of(offsets):
            of, s = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.bincount(of, minlength=j - i)
            x, y = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            have = np.flatnonzero(n)
            if len(have):
                at = np.searchsorted(of, have)
                x[have], y[have] = np.bitwise_xor.reduceat(mix(s ^ U(0x5851F42D4C957F2D)), at), np.add.reduceat(mix(s ^ U(0x14057B7EF767814F)), at)
            tokens.append(s)
            none = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(n), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), none, none], names=names)
            held += len(s)
            if held >= FLUSH:
                yield frequent()
                tokens, held = [], 0
    if held:
        yield frequent()


def prefix_keys(of: np.ndarray, s: np.ndarray, m: np.ndarray, bits: np.ndarray, most: np.ndarray, often: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the first ``most`` + 1 blocks of each document in ``ask``; blocks that are all frequent come last."""
    use = ask[of]
    of, s = of[use], s[use]
    if not len(of):
        return of, s
    block = s >> (U(64) - bits[of].astype(np.uint64))
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(s, at)
    place = np.searchsorted(often, s)
    frequent = (often[np.minimum(place, len(often) - 1)] == s) if len(often) else np.zeros(len(s), bool)
    last = np.logical_and.reduceat(frequent, at)
    of, block = of[at], block[at]
    key = mix(parity ^ mix(block * U(64) + bits[of].astype(np.uint64)))
    order = np.lexsort((key, last, of))
    of, key = of[order], key[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    keep = rank <= most[of]
    return of[keep], key[keep]


KEYS = "key long, r long, leader long, led boolean"


def _keys(often: np.ndarray):
    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, held = [], [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(b.column(1))
            for i, j in groups_of(offsets):
                of, s = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                m = np.bincount(of, minlength=j - i)
                bits, top = band(m)
                # partners in the band, larger or smaller; and larger ones in the next band
                own = (3 * m + np.minimum(4 * m, 3 * top)) // 21
                for most, shift, ask in ((own, bits, m > 0), (m // 3, band(top + 1)[0], (m > 0) & (4 * m > 3 * top))):
                    d, k = prefix_keys(of, s, m, shift, most, often, ask)
                    docs.append(ids[d + i])
                    keys.append(k)
                    held += len(k)
                if held >= FLUSH // 4:
                    yield _led(np.concatenate(docs), np.concatenate(keys))
                    docs, keys, held = [], [], 0
        if held:
            yield _led(np.concatenate(docs), np.concatenate(keys))

    return find


def _led(r: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    """Documents and keys that were gathered: a key's documents follow its first one, so that a key leaves them once."""
    _, first, back, count = np.unique(k, return_index=True, return_inverse=True, return_counts=True)
    back = back.ravel()
    lead = first[back]
    own = lead == np.arange(len(k))
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(r), pa.array(r[lead], mask=own), pa.array(own & (count[back] > 1))], names=["key", "r", "leader", "led"])


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's shingle hashes, in order, as bytes."""
    for b in batches:
        data, offsets = text_buffer(b.column(1))
        for i, j in groups_of(offsets):
            of, s = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts = np.split(s, np.searchsorted(of, np.arange(1, j - i)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([p.tobytes() for p in parts], pa.binary())], names=["r", "tokens"])


INFO = "r long, m int, " + ", ".join(f"k{i} long" for i in range(SKETCH))


@released
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and 512-bit parity sketch."""
    width = 64 * SKETCH
    for b in batches:
        data, offsets = text_buffer(b.column(1))
        for i, j in groups_of(offsets):
            of, s = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = j - i
            parity = np.bincount(of * width + (mix(s ^ U(0x2545F4914F6CDD1D)) % U(width)).astype(np.int64), minlength=n * width) & 1
            words = np.packbits(parity.astype(np.uint8).reshape(n, width), axis=1).view(np.int64)
            m = np.bincount(of, minlength=n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(m), *(pa.array(np.ascontiguousarray(words[:, c])) for c in range(SKETCH))], names=[x.split()[0] for x in INFO.split(", ")])


@released
def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar: 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= 75 * (len(one) + len(two) - both) and both > 0)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


@released
def _long_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and a parity sketch of about as many bits as the set has members, 512 at least."""
    for b in batches:
        data, offsets = text_buffer(b.column(1))
        for i, j in groups_of(offsets):
            of, s = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            m = np.bincount(of, minlength=j - i)
            cut = np.concatenate(([0], np.cumsum(m)))
            place = mix(s ^ U(0x2545F4914F6CDD1D))
            bits = []
            for k in range(j - i):
                width = max(512, 1 << max(0, int(m[k]) - 1).bit_length())
                parity = np.bincount((place[cut[k] : cut[k + 1]] & U(width - 1)).astype(np.int64), minlength=width) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(m.astype(np.int64)), pa.array(bits, pa.binary())], names=["r", "m", "bits"])


@released
def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow similarity; the longer sketch is folded onto the shorter, which keeps parities."""
    for batch in batches:
        keep = []
        for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep.append(4 * min(m, n) >= 3 * max(m, n) and 7 * int(np.bitwise_count(x ^ y).sum()) <= m + n)
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of the table's rows for a and for b."""
    left = table.select(F.col("r").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = table.select(F.col("r").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))


def _of_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("r")).union(pairs.select("b")).distinct()
    return texts.join(small_keys(nodes), "r", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are similar: sketches as long as the sets are compared first, then the sets of the pairs left.

    Both are made from the texts of the documents that occur in a pair.
    """
    pairs = materialise(pairs, "pairs")
    bits = materialise(_of_pairs(pairs, texts).mapInArrow(_long_sketches, "r long, m long, bits binary"), "bits")
    near = materialise(_joined(pairs, bits, "m", "bits").mapInArrow(_near_enough, "a long, b long"), "near")
    discard(pairs, bits)
    sets = materialise(_of_pairs(near, texts).mapInArrow(_sets, "r long, tokens binary"), "sets")
    out = materialise(_joined(near, sets, "tokens").mapInArrow(_similar, "a long, b long"), name)
    discard(near, sets)
    return out


def _may_link(x, y):
    """Whether two rows' sizes and sketches allow similarity; ``x`` and ``y`` give a column of either row by name."""
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(x(f"k{i}").bitwiseXOR(y(f"k{i}")))
    return (4 * F.least(x("m"), y("m")) >= 3 * F.greatest(x("m"), y("m"))) & (7 * apart <= x("m") + y("m"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component c of the document r; a document without a link is its own."""
    of = small_keys(label.select(F.col("node").alias("r"), F.col("component").alias("_c")))
    return rows.join(of, "r", "left").withColumn("c", F.coalesce("_c", "r")).drop("_c")


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after the links (a, b) between documents; the graph that is solved is that of components."""
    ends = _labelled(_labelled(links.select(F.col("a").alias("r"), "b"), label).select(F.col("b").alias("r"), F.col("c").alias("a")), label)
    over = materialise(components(ends.select("a", F.col("c").alias("b")).distinct()), "over")
    up = small_keys(over.select(F.col("node").alias("component"), F.col("component").alias("_top")))
    moved = label.join(up, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    alone = over.join(label.select("node"), "node", "left_anti").select("node", "component")
    out = materialise(moved.unionByName(alone), "label")
    discard(label, over)
    return out


def _neighbour_rounds(rows: DataFrame, label: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels, and the rows of keys that still hold several components, after rounds that join most of what can be joined.

    In each round the documents of a key stand in a random order of their own and each looks at the next one; of all such
    pairs between the same two components the one with the nearest sketches is verified.  A round is linear in the rows and
    loses nothing: what it doesn't link is left for the next round, and in the end for the comparison of all pairs.
    Keys of many documents are split for the order.  Rounds end when less than a tenth of the pairs tried are links.
    """
    for turn in range(ROUNDS):
        held = _labelled(rows, label)
        split = Window.partitionBy("key", F.pmod(F.xxhash64("r", F.lit(turn)), 1 + (F.col("n") / SPLIT).cast("long"))).orderBy(F.xxhash64("key", "r", F.lit(turn)), "r")
        follower = F.lead(F.struct("r", "c", "m", *(f"k{i}" for i in range(SKETCH)))).over(split)
        pair = held.select("*", follower.alias("o")).filter(F.col("o.c") != F.col("c")).filter(_may_link(F.col, lambda c: F.col(f"o.{c}")))
        ratio = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"o.k{i}"))) for i in range(SKETCH)), F.lit(0)) / (F.col("m") + F.col("o.m"))
        one = pair.groupBy(F.least("c", "o.c").alias("u"), F.greatest("c", "o.c").alias("v")).agg(F.min(F.struct(ratio.alias("d"), F.col("r").alias("a"), F.col("o.r").alias("b"))).alias("p"))
        tried = materialise(one.select("p.a", "p.b"), "tried")
        n = tried.count()
        links = _verified(tried, texts, "links") if n else tried
        found = links.count() if n else 0
        if found:
            label = _merged(label, links)
            several = _labelled(rows, label).groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low <> _high").select("key")
            left = materialise(rows.join(several, "key", "left_semi"), "rows")
            discard(rows)
            rows = left
        if found * 10 < n or not n:
            break
    return label, rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles and component_id.

    Shingles are of lower-cased (A to Z) words; a text of fewer than five words is one shingle, and a null text, or one
    without words, has none and links with nothing.  Rows that share an id are one node.  Rows without an id are no nodes
    and have component_id null.  An empty table gives no rows; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    described = materialise(base.mapInArrow(_describe, SETS), "sets-described")
    often = described.filter("token IS NOT NULL").groupBy("token").agg(F.sum("often").alias("often")).orderBy(F.desc("often"), "token").limit(OFTEN_KEPT)
    often = np.sort(np.array([r.token for r in often.select("token").collect()], np.int64).view(np.uint64))  # an order of keys, 4 MB at most
    sets = described.filter("token IS NULL").select("doc_id", "n", "x", "y")
    # equal sets are one node, named by their smallest document
    equal = materialise(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep")), "equal")
    member = materialise(sets.filter("n > 0 AND doc_id IS NOT NULL").join(equal, ["n", "x", "y"]).select("doc_id", "rep").distinct(), "member")
    named = member.filter("doc_id = rep").select("doc_id")
    copies = member.filter("doc_id <> rep").join(named, "doc_id", "left_anti").select(F.col("doc_id").alias("r")).distinct()
    # an id with several texts joins their nodes
    several = member.groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1).select(F.explode("reps").alias("a"), "b")
    texts = base.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("r"), "_text").join(small_keys(copies), "r", "left_anti")

    keys = materialise(texts.mapInArrow(_keys(often), KEYS), "keys")
    by_key = Window.partitionBy("key")
    led = keys.filter("leader IS NULL").select("key", "r", "led", F.count(F.lit(1)).over(by_key).alias("n"), F.min("r").over(by_key).alias("leader"))
    led = materialise(led.filter("n > 1 OR led").select("key", "r", "leader"), "led")
    followers = keys.filter("leader IS NOT NULL").select("key", "r", "leader")
    shared = materialise(led.union(followers), "shared")
    discard(keys, led)
    del keys, led, followers

    # first round: each document against the leader it shares most keys with
    counted = shared.filter("r <> leader").groupBy("r", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("r").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    first = _verified(best.select(F.col("r").alias("a"), F.col("leader").alias("b")), texts, "first")
    label = materialise(components(first.union(several)), "label")
    discard(first)

    placed = materialise(_labelled(shared.select("key", "r").distinct(), label), "placed")
    # keys with the same documents say the same: one of them stays, told by a 128-bit fingerprint of the documents
    spread = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("r")).alias("x"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("y"))
    apart = spread.filter("low <> high").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    apart = materialise(placed.select("key", "r").join(apart, "key"), "apart")
    discard(placed, shared)
    del placed, shared
    info = materialise(texts.join(small_keys(apart.select("r").distinct()), "r", "left_semi").mapInArrow(_sketches, INFO), "sketches")
    rows = materialise(apart.join(info, "r"), "apart-sketched")
    discard(apart, info)
    label, rows = _neighbour_rounds(rows, label, texts)

    # last: every pair that shares a key and is still in two components
    rows = _labelled(rows, label)
    # documents that share many keys would meet in each: a pair meets where no key shortly before, in both lists, is shared
    # (where a list has none before, its document's id stands, which no other document has)
    in_list = Window.partitionBy("r").orderBy("key")
    rows = materialise(rows.select("*", *(F.coalesce(F.lag("key", i).over(in_list), F.col("r")).alias(f"p{i}") for i in range(1, BEFORE + 1))), "last-rows")
    x, y = rows.alias("x"), rows.alias("y")
    met = F.lit(False)
    for i in range(1, BEFORE + 1):
        for j in range(1, BEFORE + 1):
            met = met | (F.col(f"x.p{i}") == F.col(f"y.p{j}"))
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") < F.col("y.c")) & ~met & _may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    last = _verified(x.join(y, near).select(F.col("x.r").alias("a"), F.col("y.r").alias("b")).distinct(), texts, "last")
    label = _merged(label, last)
    discard(rows, last)
    place = label.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    final = member.join(place, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("c", "rep")).alias("_component")).withColumnRenamed("doc_id", "_node")
    return sets.join(final, sets["doc_id"] == final["_node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not their component's smallest; columns as they were.

    Rows without words (or with a null text) are alone in their component and stay, as do rows without an id; rows that
    repeat the smallest id all stay; an empty table gives no rows.
    """
    kept = near_duplicates(docs, id_col, text_col).filter("component_id < doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(small_keys(kept), docs[id_col] == F.col("_drop"), "left_anti")
