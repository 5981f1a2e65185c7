"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has a bit for each of the 64 bits of its shingles' XXH64 (seed 42): set
where more than half of the shingles (repeats included) have it set. Documents link where their
fingerprints differ in at most ``distance`` bits, and groups are what links connect.

Fingerprints within ``distance`` of each other agree on all but ``distance`` of any ranges that the
bits are cut into: on one of five, two of six, three of seven. Each distinct fingerprint goes to a
bucket for each such choice, and the more there are the longer the keys. A bucket's fingerprints are sorted by their
rank in the Gray code; consecutive ones form groups whose shared bits (what all set, what all
clear) are factored into a node, and nodes form upper nodes. Pairs of nodes are compared from the
top: where the bits in which all of one differ from all of the other add up to more than
``distance`` the pair is dropped whole, and so is one that is connected already. A bucket returns
a spanning forest of its links, never their pairs, so a large group of near copies costs rows in
proportion to its distinct fingerprints.

Null and empty texts, and those without a word, have the fingerprint zero and link like any other.
A null doc_id takes part, and is the component_id only of components where all are null. Rows that
repeat a doc_id, with equal texts or not, each take part and have a row in the result. A tie can't
be: the smallest doc_id names the component. Other columns may have any names. An empty table gives
an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from simplark.llm.common import cut, join_keys, named, small, without
from simplark.llm.components import components

DISTANCE = 4
SHINGLE = 4
FAN = 32


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """The text's 64-bit fingerprint; words are lower-cased (A-Z) runs of other than ASCII white space."""
    if not text:
        return 0
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(flat[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches):
        for batch in small(batches, 1):
            found = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    shaped = docs.select(named(key).alias("doc_id"), named(text).cast("binary").alias("t"))
    return shaped.mapInArrow(run, shaped.select("doc_id").schema.add("fp", "long"))


def parts_for(n: int, distance: int = DISTANCE, bucket: int = 1 << 12) -> int:
    """Into how many ranges the bits are cut for n distinct fingerprints, so that a bucket of random ones has ``bucket`` at most.

    Near fingerprints agree on all ranges but ``distance``, and the bits of those make the key.
    """
    parts = distance + 1
    while n >> (64 * (parts - distance) // parts) > bucket and parts < 2 * distance:
        parts += 1
    return parts


def ranges(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the ranges that 64 bits are cut into."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where x stands in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Disjoint sets over 0..n-1, their roots the smallest members, vectorised."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != (q := self.up[r])).any():
            r = q
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i]; keeps those links that connected something."""
        while len(a):
            ra, rb = self.root(a), self.root(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                break
            high, low = np.maximum(ra, rb), np.minimum(ra, rb)
            tops, first = np.unique(high, return_index=True)  # one link for each root, so that no set is lost
            self.up[tops] = low[first]
            self.links.append((a[first], b[first]))
        self.up = self.root(np.arange(len(self.up)))


def levels(fp: np.ndarray, bucket: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The index over fingerprints sorted by (bucket, Gray rank), leaves first.

    A node has the bits that all its members set (every) or that any sets (some), where it begins
    and ends in the level below, and its bucket. No node spans two buckets.
    """
    out = [{"every": fp, "some": fp, "bucket": bucket}]
    while True:
        below = out[-1]
        n = len(below["bucket"])
        fresh = np.concatenate(([True], below["bucket"][1:] != below["bucket"][:-1]))
        begun = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        first = np.flatnonzero((np.arange(n) - begun) % FAN == 0)
        if len(first) == n:
            return out
        out.append({
            "every": np.bitwise_and.reduceat(below["every"], first),
            "some": np.bitwise_or.reduceat(below["some"], first),
            "bucket": below["bucket"][first],
            "begin": first,
            "end": np.append(first[1:], n),
        })


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, member) for every member of every range."""
    count = end - begin
    owner = np.repeat(np.arange(len(begin)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)


def linked(fp: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as positions, of the links within buckets; sorted by bucket and Gray rank.

    Depth first by blocks of at most about ``most`` pairs, so memory stays bounded.
    """
    tree, forest = levels(fp, bucket), Forest(len(fp))
    spans = [np.arange(len(fp))]  # the first leaf below each node
    tails = [np.arange(len(fp))]
    for level in tree[1:]:
        spans.append(spans[-1][level["begin"]])
        tails.append(tails[-1][level["end"] - 1])
    top = len(tree) - 1
    every = np.arange(len(tree[top]["bucket"]))
    stack = [(top, every, every)]

    def whole(depth: int, node: np.ndarray) -> np.ndarray:
        """The component of all leaves of a node, or -1: roots of sorted leaves are compared by prefix changes."""
        root = forest.up
        changes = np.concatenate(([0], np.cumsum(root[1:] != root[:-1])))
        a, b = spans[depth][node], tails[depth][node]
        return np.where(changes[a] == changes[b], root[a], -1)

    while stack:
        depth, a, b = stack.pop()
        if len(a) > most:
            cutoff = len(a) // 2
            stack += [(depth, a[cutoff:], b[cutoff:]), (depth, a[:cutoff], b[:cutoff])]
            continue
        level = tree[depth]
        apart = (level["every"][a] & ~level["some"][b]) | (level["every"][b] & ~level["some"][a])
        near = np.bitwise_count(apart) <= distance
        a, b = a[near], b[near]
        if depth == 0:
            forest.join(a, b)
            continue
        ca, cb = whole(depth, a), whole(depth, b)
        open_ = (ca != cb) | (ca < 0)
        a, b = a[open_], b[open_]
        for i in range(0, len(a), most // FAN):
            x, y = a[i : i + most // FAN], b[i : i + most // FAN]
            own, left = spread(level["begin"][x], level["end"][x])
            pair, right = spread(level["begin"][y][own], level["end"][y][own])
            left = left[pair]
            once = (x != y)[own][pair] | (left <= right) if depth > 1 else (x != y)[own][pair] | (left < right)
            stack.append((depth - 1, left[once], right[once]))
    if not forest.links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*forest.links, strict=True))
    return a, b


def link_buckets(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect what links connect.

    Of ``parts`` ranges (by default as many as the number of fingerprints asks for) near ones agree on
    ``parts - distance``: each choice of so many ranges is a key.
    """
    cut_ = ranges(parts or parts_for(distinct.count(), distance))
    masks = [sum(((1 << width) - 1) << low for low, width in some) for some in combinations(cut_, len(cut_) - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size, wait = 0, 1 << 16

        def flush(table: pa.Table):
            bucket, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(fp), bucket))
            fp, bucket = fp[order], bucket[order]
            a, b = linked(fp, bucket, distance)
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

        def numbered(batch: pa.RecordBatch, before) -> tuple[pa.RecordBatch, tuple]:
            """The batch with the numbers of its buckets, which come one after another."""
            mask, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.concatenate(([before is None or (mask[0], bits[0]) != before[:2]], (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
            number = (before[2] if before else 0) + np.cumsum(fresh)
            return pa.RecordBatch.from_arrays([pa.array(number), batch.column(2)], ["bucket", "fp"]), (mask[-1], bits[-1], int(number[-1]))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch, last = numbered(batch, last)
            held.append(batch)
            size += batch.num_rows
            if size >= wait:  # whole buckets that have passed; one that hasn't waits for twice as much
                table = pa.Table.from_batches(held)
                bucket = table.column(0).to_numpy()
                if at := int(np.searchsorted(bucket, bucket[-1])):
                    yield flush(table.slice(0, at))
                held = table.slice(at).to_batches()
                size = len(bucket) - at
                wait = max(1 << 16, 2 * size)
        if held:
            yield flush(pa.Table.from_batches(held))

    dealt = distinct.select(F.explode(keys).alias("k"), "fp").select("k.mask", "k.bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of what links connect) of every row."""
    keyed = cut(fingerprints(docs, key, text, shingle))
    firsts = cut(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_docs")))
    roots = components(link_buckets(firsts.select("fp"), distance))
    tied = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp"))  # fingerprints with a link
    ids = tied.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_keys(tied.select("fp", "root"), ids, ["root"], "n").select("fp", "component_id")
    every = firsts.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n_docs")
    return join_keys(keyed, every, ["fp"], "n_docs").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_groups(docs, key, text, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The documents whose doc_id is its component's smallest, all columns as they are.

    Rows that share a doc_id share its fate: they go where every one of them has a smaller
    neighbour, else they stay. Rows with a null doc_id stay.
    """
    groups = simhash_groups(docs, key, text, distance)
    dropped = groups.groupBy("doc_id").agg(F.min(F.col("component_id") < F.col("doc_id")).alias("gone")).where("gone")
    return without(docs, key, dropped, "doc_id")
