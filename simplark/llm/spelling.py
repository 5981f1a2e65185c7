"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors.

One inserted, deleted or replaced letter moves a word's vector of letter counts by an L1 distance
of at most two: by one upwards into the next length, or by one up and one down within a length.
So there is a tree for each length, searched by the words of that length and of the one below.

A vector has ``LETTERS`` counts (code points that are equal modulo 32 share one, so accents don't
widen it), each told apart at two levels; longer words take higher levels. It is kept as a number
of 64 bits, one for each (letter, level): "the word has the letter at least so often". A split of
the tree asks one such bit, the box of a node is the AND and the OR of its words, and the numbers
of bits that a query has beyond the OR and lacks of the AND are its distances up and down. A box
that is over one away in either direction is pruned. What a leaf still offers is compared by
vector, then letter by letter.

On Spark the upper part of each tree deals the words out. It is built from a bounded sample, which
decides only who works with whom; the boxes come from an aggregate over all words. Each
word goes to its own leaf as a point and, as a query, to the leaves whose box it can reach;
leaves with too many of either are cut into a grid of parts, where each query meets
each point once. A task builds the lower tree of its part and searches it in numpy.

Words are counted by built-in functions with partial sums, so a frequent word is one row of each task.
The number of words near a word is bounded by its length and the alphabet, and ``near`` adds up
inside tasks first. Roots come from doubling the steps along forms; forms rise in frequency
by a factor of two, so there are few rounds.

Defined cases: a null text has no words; a null doc_id stands for the empty text in the checksum;
repeated rows count again; words may be as long as a row; an empty table gives no rows. Equal
frequencies: the smaller word in code-point order is the form. Other columns may have any names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import UPPER, cut, join_keys, named, written

LETTERS = 32
#: Words of a leaf of the upper trees, points and queries of a part, words of a leaf of the lower trees.
LEAF, PART, BUNCH = 8192, 262_144, 16
#: Words that the upper trees are built from, and leaves that they may have in all.
SAMPLE, LEAVES = 65_536, 4096
#: Queries that are searched, and pairs that are compared, at a time.
QUERIES, PAIRS = 4096, 1 << 20
ONE = np.uint64(1)


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", deleted: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the runs of letters of all texts, lower-cased (A-Z only), that have ``shortest`` code points and occur ``least`` times.

    Where ``deleted`` divides the crc32 of ``<key>:<run>``, the run has lost the code point at that checksum modulo its length.
    """
    runs = F.regexp_extract_all(F.translate(named(text), UPPER, UPPER.lower()), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    each = docs.select(F.coalesce(named(key).cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % deleted != 0, F.col("run")).otherwise(F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
    words = each.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points, all below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(letters: np.ndarray, length: int) -> np.ndarray:
    """The letter counts of each row, coded for the tree of words of ``length``."""
    rows = len(letters)
    at = letters % LETTERS + LETTERS * np.arange(rows, dtype=np.int64)[:, None]
    counts = np.bincount(at.ravel(), minlength=rows * LETTERS).reshape(rows, LETTERS)
    level = 1 + length // 24
    bits = np.concatenate((counts >= level, counts > level), axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def excess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that ``a`` has beyond ``b``."""
    return np.bitwise_count(a & ~b)


class Tree:
    """A k-d tree; a node splits by the bit of ``split`` (-1: a leaf, with the words ``start`` to ``end`` of ``order``)."""

    def __init__(self, points: np.ndarray, bunch: float, most_leaves: int = 1 << 30):
        bits = np.unpackbits(points[:, None].view(np.uint8), axis=1, bitorder="little")
        self.split, self.down, self.start, self.end = [], [], [], []
        parts, todo = [], [(np.arange(len(points)), None)]
        leaves, placed = 1, 0
        while todo:
            rows, parent = todo.pop()
            node = len(self.split)
            if parent is not None:
                self.down[parent[0]][parent[1]] = node
            half = np.abs(2 * bits[rows].sum(0, dtype=np.int64) - len(rows))
            best = int(half.argmin())
            if len(rows) > bunch and half[best] < len(rows) and leaves < most_leaves:
                leaves += 1
                self.split.append(best)
                self.down.append([0, 0])
                self.start.append(0)
                self.end.append(0)
                one = bits[rows, best] == 1
                todo += [(rows[one], (node, 1)), (rows[~one], (node, 0))]
            else:
                self.split.append(-1)
                self.down.append([0, 0])
                self.start.append(placed)
                placed += len(rows)
                self.end.append(placed)
                parts.append(rows)
        self.split, self.down, self.start, self.end = (np.array(x, np.int64) for x in (self.split, self.down, self.start, self.end))
        self.order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.numbers = np.cumsum(self.split < 0) - 1  # of leaves, in order

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        while (inner := np.flatnonzero(self.split[at] >= 0)).size:
            side = points[inner] >> self.split[at[inner]].astype(np.uint64) & ONE
            at[inner] = self.down[at[inner], side.astype(np.int64)]
        return self.numbers[at]

    def boxed(self, low: np.ndarray, high: np.ndarray) -> Tree:
        """With the boxes of the leaves (AND and OR, by number), and from them those of all nodes."""
        self.low, self.high = np.zeros(len(self.split), np.uint64), np.zeros(len(self.split), np.uint64)
        ends = self.split < 0
        self.low[ends], self.high[ends] = low, high
        for node in range(len(self.split) - 1, -1, -1):  # children come after their parents
            if self.split[node] >= 0:
                a, b = self.down[node]
                self.low[node], self.high[node] = self.low[a] & self.low[b], self.high[a] | self.high[b]
        return self

    def reached(self, queries: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all leaves within reach; ``up`` marks queries that are a letter short of the tree's words."""
        q, at, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(q):
            v = queries[q]
            near = (excess(self.low[at], v) <= 1) & (excess(v, self.high[at]) <= ~up[q])
            q, at = q[near], at[near]
            leaf = self.split[at] < 0
            found.append((q[leaf], at[leaf]))
            q, at = np.repeat(q[~leaf], 2), self.down[at[~leaf]].ravel()
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (q, at)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one edit; ``b`` has as many letters or one more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ends = np.ones((len(a), 1), bool)
    front = np.concatenate((a != b[:, :-1], ends), axis=1).argmax(1)
    back = np.concatenate(((a != b[:, 1:])[:, ::-1], ends), axis=1).argmax(1)
    return front + back >= a.shape[1]


def by_length(words: pa.Array):
    """For each length of words: (length, their places)."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield int(n), np.flatnonzero(lengths == n)


def with_vectors(batches):
    for batch in batches:
        words = batch.column(0)
        length, vector = np.zeros(len(words), np.int32), np.zeros(len(words), np.uint64)
        for n, at in by_length(words):
            length[at] = n
            step = max(1, (1 << 22) // n)  # letters at a time
            vector[at] = np.concatenate([vectors(codes(words.take(part).to_pylist()), n) for part in (at[i : i + step] for i in range(0, len(at), step))])
        yield pa.RecordBatch.from_arrays([words, batch.column(1), pa.array(length), pa.array(vector.view(np.int64))], names=["word", "n", "length", "vector"])


class Forest:
    """The upper trees by length; their leaves are numbered on through all lengths."""

    def __init__(self, samples: dict[int, np.ndarray], totals: dict[int, int]):
        self.trees, self.first, n = {}, {}, 0
        whole = sum(totals.values())
        for length in sorted(totals):
            sample = samples.get(length, np.zeros(0, np.uint64))
            most = max(1, LEAVES * totals[length] // whole)
            self.trees[length] = Tree(sample, LEAF * len(sample) / totals[length], most)
            self.first[length] = n
            n += int(self.trees[length].numbers[-1]) + 1
        self.leaves = n

    def boxed(self, low: np.ndarray, high: np.ndarray) -> None:
        for length, tree in self.trees.items():
            own = slice(self.first[length], self.first[length] + int(tree.numbers[-1]) + 1)
            tree.boxed(low[own], high[own])

    def homes(self, length: int, v: np.ndarray) -> np.ndarray:
        return self.first[length] + self.trees[length].leaf_of(v)

    def visits(self, length: int, v: np.ndarray, up: np.ndarray, homes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf); of two leaves of one length the earlier one's words visit the later one."""
        if length not in self.trees:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tree = self.trees[length]
        q, node = tree.reached(v, up)
        leaf = self.first[length] + tree.numbers[node]
        if homes is not None:
            later = leaf >= homes[q]
            q, leaf = q[later], leaf[later]
        return q, leaf


def leaf_columns(forest: Forest):
    def run(batches):
        for batch in batches:
            length, v = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            leaf = np.zeros(len(v), np.int32)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                leaf[at] = forest.homes(int(n), v[at])
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(3)], names=["leaf", "vector"])

    return run


#: What a routed row is: a point, a query from its own leaf, from another leaf of its length, from the length below.
POINT, OWN, OTHER, SHORTER = range(4)


def routed(forest: Forest, points: np.ndarray | None = None, queries: np.ndarray | None = None):
    """Rows for every part that a word takes part in; without the counts of the leaves only (leaf, role)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                part = batch.slice(start, QUERIES)
                length, v = part.column(2).to_numpy(), part.column(3).to_numpy().view(np.uint64)
                rows, leaves, roles = [], [], []
                for n in map(int, np.unique(length)):
                    at = np.flatnonzero(length == n)
                    homes = forest.homes(n, v[at])
                    q, leaf = forest.visits(n, v[at], np.zeros(len(at), bool), homes)
                    # The vector for the next length may have other levels.
                    longer = v[at] if n // 24 == (n + 1) // 24 else vectors(codes(part.column(0).take(at).to_pylist()), n + 1)
                    q2, leaf2 = forest.visits(n + 1, longer, np.ones(len(at), bool))
                    rows += [at, at[q], at[q2]]
                    leaves += [homes, leaf, leaf2]
                    roles += [np.full(len(at), POINT), np.where(leaf == homes[q], OWN, OTHER), np.full(len(q2), SHORTER)]
                row, leaf, role = np.concatenate(rows), np.concatenate(leaves), np.concatenate(roles).astype(np.int8)
                if points is None:
                    yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(role)], names=["leaf", "role"])
                    continue
                p_parts, q_parts = 1 + points[leaf] // PART, 1 + queries[leaf] // PART
                is_point, number = role == POINT, hash_of(part.column(0))[row]
                copies = np.where(is_point, q_parts, p_parts)
                k = np.repeat(np.arange(len(row)), copies)
                each = np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
                own = number[k] % np.where(is_point[k], p_parts[k], q_parts[k])
                y, x = np.where(is_point[k], own, each), np.where(is_point[k], each, own)
                taken = part.select([0, 1]).take(pa.array(row[k]))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[k].astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(role[k]), *taken.columns], names=["leaf", "y", "x", "role", "word", "n"])

    return run


def hash_of(words: pa.Array) -> np.ndarray:
    """A number of each word, for dealing out."""
    return np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.int64)


def candidates(tree: Tree, points: np.ndarray, queries: np.ndarray, up: np.ndarray):
    """(query, point) whose vectors are near enough, in portions."""
    for start in range(0, len(queries), QUERIES):
        v, short = queries[start : start + QUERIES], up[start : start + QUERIES]
        q, node = tree.reached(v, short)
        sizes = tree.end[node] - tree.start[node]
        portion = np.cumsum(sizes) // PAIRS
        for k in range(0 if not len(q) else int(portion[-1]) + 1):
            here = np.flatnonzero(portion == k)
            n = sizes[here]
            a = np.repeat(q[here], n)
            b = tree.order[np.repeat(tree.start[node[here]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            near = (excess(points[b], v[a]) <= 1) & (excess(v[a], points[b]) <= ~short[a])
            yield a[near] + start, b[near]


def near_in_part(table: pa.Table) -> pa.Table:
    """Of each word of a part: how many near words it has here, and the most frequent one of them."""
    table = table.combine_chunks()
    role = table.column("role").to_numpy()
    words, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
    if isinstance(words, pa.ChunkedArray):
        words = words.chunk(0)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    p = np.flatnonzero(role == POINT)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    if len(p):
        length = int(lengths[p[0]])
        point_codes = codes(words.take(p).to_pylist())
        point_vectors = vectors(point_codes, length)
        tree = Tree(point_vectors, BUNCH)
        sorted_vectors = point_vectors[tree.order]
        starts = tree.start[tree.split < 0]
        tree.boxed(np.bitwise_and.reduceat(sorted_vectors, starts), np.bitwise_or.reduceat(sorted_vectors, starts))
        step = max(1, PAIRS // length)
        for short in (False, True):
            q = np.flatnonzero((role == SHORTER) if short else (role == OWN) | (role == OTHER))
            for qs in (q[i : i + 16 * QUERIES] for i in range(0, len(q), 16 * QUERIES)):
                query_codes = codes(words.take(qs).to_pylist())
                for a, b in candidates(tree, point_vectors, vectors(query_codes, length), np.full(len(qs), short)):
                    for i in range(0, len(a), step):
                        x, y = a[i : i + step], b[i : i + step]
                        near = one_edit(query_codes[x], point_codes[y])
                        pairs.append((qs[x[near]], p[y[near]]))
    x, y = (np.concatenate(z) if pairs else np.zeros(0, np.int64) for z in (zip(*pairs, strict=True) if pairs else ((), ())))
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    # Within a leaf each pair comes up from both sides.
    once = (role[x] != OWN) | (rank[x] < rank[y])
    x, y = np.concatenate((x[once], y[once])), np.concatenate((y[once], x[once]))
    # A word may be here as a point and as a query; they are told apart by row and meet in the last sum.
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else x
    found = np.diff(np.append(first, len(x)))
    return pa.table({"word": words.take(pa.array(x[first])), "found": pa.array(found.astype(np.int64)), "near_n": pa.array(n[y[first]]), "near": words.take(pa.array(y[first]))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): of the words that have near words, their number and the most frequent one as (minus n, word)."""
    coded = written(words.mapInArrow(with_vectors, "word string, n long, length int, vector long"))
    totals = {r.length: r.n for r in coded.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = coded.select("length", "vector").orderBy(F.xxhash64("word"), "word").limit(SAMPLE).toPandas()
    samples = {int(k): g.to_numpy(np.int64).view(np.uint64) for k, g in chosen.groupby("length")["vector"]}
    forest = Forest(samples, totals)
    low, high, points = np.full(forest.leaves, ~np.uint64(0)), np.zeros(forest.leaves, np.uint64), np.zeros(forest.leaves, np.int64)
    homes = coded.mapInArrow(leaf_columns(forest), "leaf int, vector long").groupBy("leaf")
    for r in homes.agg(F.count(F.lit(1)).alias("n"), F.bit_and("vector").alias("low"), F.bit_or("vector").alias("high")).collect():
        points[r.leaf], low[r.leaf], high[r.leaf] = r.n, np.int64(r.low).view(np.uint64), np.int64(r.high).view(np.uint64)
    forest.boxed(low, high)
    queries = np.zeros(forest.leaves, np.int64)
    for r in coded.mapInArrow(routed(forest), "leaf int, role byte").where(F.col("role") != POINT).groupBy("leaf").count().collect():
        queries[r.leaf] = r["count"]
    dealt = coded.mapInArrow(routed(forest, points, queries), "leaf int, y int, x int, role byte, word string, n long")
    found = dealt.groupBy("leaf", "y", "x").applyInArrow(near_in_part, "word string, found long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best)


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root): the last word on the way along ``forms`` (word, form), for the words that have one. Ways may not be circles."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        # A round doubles the steps; a root that many words share may be hot.
        met = now.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further")).join(met, "root")
        if not (further := cut(further)).take(1):
            return now
        joined = join_keys(now, further, ["root"], "rows", "left")
        now = cut(joined.select("word", F.coalesce("further", "root").alias("root")))
    raise RuntimeError(f"forms haven't ended after {most_rounds} rounds")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): form is the most frequent near word if it is ``ratio`` times as frequent."""
    words = written(words)
    met = words.join(near_words(words), "word", "left")
    is_form: Column = -F.col("best.minus_n") >= ratio * F.col("n")
    shaped = written(met.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.minus_n")).alias("form_n")))
    ends = roots(shaped.where(F.col("form").isNotNull()).select("word", "form"))
    return shaped.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants among the words of all texts."""
    return variants(counted_words(docs, key, text))
