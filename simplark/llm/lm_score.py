"""Language-model scoring by logistic context mixing, beside a unigram baseline.

The model reads lower-cased (A-Z) UTF-8 bytes and an end symbol. Each byte is a short path of bits
(a Huffman code over the training bytes), and each bit is predicted from several hashed contexts:
the last two, three and five bytes and the word so far (its last ``LEAD`` bytes). Every context has
counts of both bits in a table. The predictions' logits are added up with weights that a gate chooses
(depth of the bit, and whether the longest contexts are known), and the sum is refined by an
adaptive map of what such sums were worth. Total bits are the text's cost.

Training is online and distributed: a task walks through its documents in blocks, predicts a block
with what it has counted so far, moves the gated weights along the error, adapts the map, and
only then counts the block. Counts, weights and the map take in every byte of every training
document; only before a task has counted anything, weights and map have nothing to move by. What a
block has several times (a symbol after the same contexts) is worked out once and counts as often as
it is there. Spark adds up the tasks' tables and averages their weights by the bits they saw; that part
has a fixed size (a few MB) and is broadcast, and scoring leaves it as it is.

What grows with the corpus are the long contexts, which stay a Spark table. Texts are cut into
segments behind the first white space after a word where the hash of the last 16 bytes says so (one time
in ``ANCHOR``): what stands before a place alone decides, so all texts' probabilities add up to one at most.
A segment is predicted a second time, as a whole, from those 16 bytes (or from being the first of its
text): by how often the training documents went on so. Both predictions are mixed with a weight that
depends on how often the context occurred, learned from the training documents, each without itself.
So a text that repeats what another one has costs next to nothing there, however large the corpus is.

The baseline needs the count of every word. The most frequent words, at most ``FREQUENT`` of them and
``FREQUENT_BYTES`` in all, are broadcast; the other words of each document are joined with their counts.
Hot words, contexts and segments are broadcast apart.

Defined cases: null counts as the empty text, which has the end token and the end symbol; without
training documents the model is uniform and every count is zero; a null doc_id isn't learned from
nor held out; repeated rows are each scored and each learned from; a text's contexts don't depend on
the texts beside it, nor on where a long one is cut; other columns may have any names.
"""

from __future__ import annotations

import ctypes
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import cut, extended, join_keys, named, small, written

END, PAD = 256, 257
#: Bytes of context and table size (as a power of two) of each input; 0 is the word so far.
ORDERS = ((2, 18), (3, 20), (5, 22), (0, 22))
INPUTS = len(ORDERS)
GATES = 64
#: Symbols that are worked on together; a task's first blocks have FIRST, then twice as many each time.
BLOCK, FIRST = 1 << 20, 1 << 14
#: Symbols whose contexts are worked out at once, those whose bits are predicted and counted at once, and symbols between two steps of the weights.
STRETCH, PART, COUNTED, STEP = 1 << 14, 1 << 16, 1 << 15, 1 << 14
SCALE = 16
LEAD = 64
#: Bytes before a segment, and one in how many words begins one.
LONG, ANCHOR = 16, 32
#: Words whose counts are broadcast, and their bytes.
FREQUENT, FREQUENT_BYTES = 500_000, 1 << 25
BLOCK_SLOTS = 1 << 15
BUCKETS = 33
RATE = 0.4
PRIOR = 0.4
#: How arrays are looked up bit by bit: all places are within them, and without the check that numpy makes it takes two thirds of the time.
FREE = "wrap"


# -- bits of bytes


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, node and bit by symbol and depth) of a code over the 257 symbols."""
    heap = [(int(c) + 1, s, (s,)) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in counts]
    made = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        node = made - len(counts)
        for bit, part in enumerate((a, b)):
            for s in part[2]:
                paths[s].append((node, bit))
        heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
        made += 1
    length = np.array([len(p) for p in paths] + [0], np.int64)
    depth = int(length.max())
    nodes, bits = np.zeros((len(paths) + 1, depth), np.uint32), np.zeros((len(paths) + 1, depth), np.uint8)
    for s, p in enumerate(paths):
        for k, (node, bit) in enumerate(reversed(p)):
            nodes[s, k], bits[s, k] = node, bit
    return length, nodes, bits


def blocks(texts: list, size: int = BLOCK):
    """(symbols, document, start) of blocks: documents, whole or in parts of ``BLOCK`` bytes with a lead of ``LEAD`` bytes that isn't coded.

    Symbols of the lead have the document -1; start says where a document (2) or another part of one (1)
    begins. Blocks have ``size`` symbols, or those of one part.
    """
    held, total = [], 0

    def filled():
        symbols, owner, start = np.full(total, PAD, np.int16), np.full(total, -1, np.int32), np.zeros(total, np.int8)
        end = 0
        for d, part, lead, begins, last in held:
            at = end + 5
            symbols[at : at + len(part)] = part
            end, at = at + len(part) + last, at + lead
            start[at] = begins
            owner[at:end] = d
            if last:
                symbols[end - 1] = END
        return symbols, owner, start

    for d, raw in enumerate(texts):
        whole = np.frombuffer(raw, np.uint8)
        for at in range(0, len(whole) + 1, BLOCK):  # the end alone may be a part: whether one begins depends on what is before it
            lead, last = min(at, LEAD), int(at + BLOCK > len(whole))
            held.append((d, whole[at - lead : at + BLOCK], lead, 1 if at else 2, last))
            total += 5 + len(held[-1][1]) + last
            if total >= size:
                yield filled()
                held, total = [], 0
    if held:
        yield filled()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if not _POWERS or max(_POWERS) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, BLOCK + (BLOCK >> 2))
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, np.uint64(b)))), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up, down = _POWERS[max(_POWERS)]
    return up[:n], down[:n]


def mixed_up(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Contexts:
    """What stands before each symbol of a block, worked out in stretches that fit a processor's cache."""

    hashed: list[np.ndarray]  # by input, 32 bits
    key: np.ndarray  # one number for a symbol after the same last five bytes and the same word so far
    anchors: np.ndarray  # places behind a word and one white space where the hash of the LONG bytes before says that a segment begins
    before: np.ndarray  # that hash

    @classmethod
    def of(cls, symbols: np.ndarray) -> Contexts:
        n = len(symbols)
        hashed, key = [np.empty(n, np.uint32) for _ in ORDERS], np.empty(n, np.uint64)
        found = []
        for at in range(0, n, STRETCH):
            lead = min(at, LEAD)
            part = slice(at, at + STRETCH)
            inner, keys, anchors, before = stretch(symbols[at - lead : at + STRETCH], lead)
            for out, h in zip(hashed, inner, strict=True):
                out[part] = h
            key[part] = keys
            found.append((anchors + at - lead, before))
        anchors, before = (np.concatenate(x) for x in zip(*found, strict=True))
        return cls(hashed, key, anchors, before)


def stretch(symbols: np.ndarray, lead: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of the symbols after ``lead`` ones: hashes by input, keys, places of anchors and their hashes."""
    n = len(symbols)
    s = (symbols + 1).astype(np.uint64)
    s[symbols == PAD] = 0
    up, down = powers(n + 1)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(s * up[:n], dtype=np.uint64)))
    white = (symbols == 32) | ((symbols >= 9) & (symbols <= 13)) | (symbols >= END)
    padded = np.zeros(n + 5, np.uint64)
    padded[5:] = s
    path = np.zeros(n, np.uint64)  # the last bytes, nine bits each
    hashed: list[np.ndarray] = []
    for k in range(1, 6):
        path |= padded[5 - k : 5 - k + n] << np.uint64(9 * (k - 1))
        if k in (2, 3, 5):
            hashed.append((path[lead:] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> np.uint64(32)).astype(np.uint32))
    at = np.arange(n)
    word = np.zeros(n, np.int64)
    word[1:] = np.maximum.accumulate(np.where(white, at + 1, 0))[:-1]
    start = np.maximum(word, at - LEAD)[lead:]
    full = mixed_up((sums[lead:n] - sums.take(start, mode=FREE)) * down.take(start, mode=FREE) + np.uint64(99))
    hashed.append((full >> np.uint64(32)).astype(np.uint32))
    key = mixed_up(path[lead:] * np.uint64(0xFF51AFD7ED558CCD) ^ full) * np.uint64(0xC2B2AE3D27D4EB4F) + s[lead:]
    begin = np.flatnonzero(white[1:-1] & ~white[:-2]) + 2
    begin = begin[(begin >= lead) & (begin >= LONG)]
    before = mixed_up((sums[begin] - sums[begin - LONG]) * down[begin - LONG])
    chosen = before % np.uint64(ANCHOR) == 0
    return hashed, key, begin[chosen], before[chosen]


@dataclass
class Dealt:
    """Distinct symbols after their contexts, dealt to parts by the first bits of a hash; in a part in order of rank."""

    place: np.ndarray  # the places of all symbols, equal ones side by side
    begins: np.ndarray  # where in them each distinct one begins
    first: np.ndarray  # its place
    edges: list[int]  # where among the distinct ones the parts begin, and the end

    @classmethod
    def of(cls, keys: np.ndarray, hashed: np.ndarray, ranks: np.ndarray, size: int) -> Dealt:
        """Parts of about ``size`` symbols; in them by rank, the first 22 bits of the hash and the key.

        Sorting packs the place into the lowest bits; keys that differ in those alone are told apart after it, at
        worst into more groups than there are keys.
        """
        n = len(keys)
        share = max(0, round(math.log2(n / size)))
        mask = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
        packed = hashed.astype(np.uint64) >> np.uint64(10)
        part = packed >> np.uint64(22 - share)
        packed ^= part << np.uint64(22 - share)
        packed |= (part << np.uint64(9) | ranks.astype(np.uint64)) << np.uint64(22 - share)
        packed = (packed << np.uint64(33) | keys >> np.uint64(31)) & ~mask | np.arange(n, dtype=np.uint64)
        packed.sort()
        place = (packed & mask).astype(np.int64)
        found = keys.take(place, mode=FREE)
        begins = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        edges = np.searchsorted(packed.take(begins, mode=FREE), np.arange(1, 1 << share, dtype=np.uint64) << np.uint64(64 - share if share else 0))
        return cls(place, begins, place.take(begins, mode=FREE), [0, *edges.tolist(), len(begins)])

    def parts(self, most: int):
        """(begin, end) of the parts, of at most ``most`` distinct symbols."""
        return spans(self.edges, most)


def spans(edges: list[int], most: int):
    for i, j in zip(edges, edges[1:], strict=False):
        for k in range(i, j, most):
            yield k, min(j, k + most)


class Code:
    """A code's paths. Ranks are its symbols from the longest path to the shortest, so the first of some symbols in order of rank are those that have a bit at a depth."""

    def __init__(self, length: np.ndarray, nodes: np.ndarray, bits: np.ndarray):
        self.length, self.nodes, self.bits = length, nodes, bits
        order = np.argsort(-length[: END + 1], kind="stable")
        self.rank = np.zeros(len(length), np.int64)
        self.rank[order] = np.arange(len(order))
        node, depths = nodes[order].T, nodes.shape[1]
        self.there = np.searchsorted(-length.take(order), -np.arange(depths))  # how many ranks have a bit at each depth
        self.offset = np.arange(depths) * len(order)
        self.spread = (node * np.uint32(0x85EBCA77)).ravel()
        self.base = (node * np.uint32(BUCKETS)).astype(np.int32).ravel()
        self.gate = np.repeat(np.minimum(np.arange(depths), 15).astype(np.int8) * 4, len(order))
        self.bit = bits[order].T.astype(np.int16).ravel()
        self.sign = np.float32(0.5) - self.bit.astype(np.float32)

    def layers(self, symbols: np.ndarray) -> Layers:
        """The bits of symbols in order of rank."""
        many = np.bincount(self.rank.take(symbols), minlength=END + 1)
        ranks = np.flatnonzero(many)
        many = many.take(ranks)
        ends = np.searchsorted(ranks, self.there)
        ends = ends[: np.count_nonzero(ends)]
        each = ends.tolist()
        at = np.concatenate([ranks[:k] for k in each])
        at += np.repeat(self.offset[: len(each)], ends)
        return Layers(at, np.concatenate([many[:k] for k in each]), np.cumsum(many).take(ends - 1).tolist())


@dataclass
class Layers:
    """The bits of some symbols, depth by depth, at each those of the first symbols: nothing is looked up for a bit that its symbol or its node has."""

    at: np.ndarray
    runs: np.ndarray
    ends: list[int]

    def of_nodes(self, table: np.ndarray) -> np.ndarray:
        """For each bit what the table has for its node."""
        return np.repeat(table.take(self.at), self.runs)

    def of_symbols(self, values: np.ndarray) -> np.ndarray:
        """For each bit its symbol's value."""
        return np.concatenate([values[:k] for k in self.ends])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each symbol the sum of its bits' values."""
        out, done = values[: self.ends[0]].astype(np.float64), self.ends[0]
        for k in self.ends[1:]:
            out[:k] += values[done : done + k]
            done += k
        return out

    def slots(self, hashed: np.ndarray, spread: np.ndarray, bits: int) -> np.ndarray:
        """Table places of the symbols' contexts at each bit.

        In the large tables, whose contexts have few successors, all bits after a context lie in one run of 64 places.
        """
        if bits > 20:
            x = self.of_symbols(hashed >> np.uint32(32 - bits))
            x ^= spread >> np.uint32(26)
        else:
            x = self.of_symbols(hashed)
            x ^= spread
            x *= np.uint32(0x9E3779B1)
            x >>= np.uint32(32 - bits)
        return x.view(np.int32)


def gates(depth: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
    """Depth up to 15 (times 4), and which of the longest byte context and the word are known."""
    depth += (logits[3] != 0).view(np.int8)
    known = (logits[2] != 0).view(np.int8)
    depth += known
    depth += known
    return depth.astype(np.int64)


def mixed(weights: np.ndarray, gate: np.ndarray, logits: list[np.ndarray]) -> np.ndarray:
    out = weights[:, 0].take(gate, mode=FREE) * logits[0]
    for i in range(1, INPUTS):
        more = weights[:, i].take(gate, mode=FREE)
        more *= logits[i]
        out += more
    return np.clip(out, -8, 8, out=out)


def bucket(base: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The place in the map; ``base`` is the first of the node's."""
    out = (mix * np.float32(2) + np.float32(16.5)).astype(np.int32)
    out += base
    return out


def logits_of(counts: np.ndarray) -> np.ndarray:
    """The logit, times SCALE, of each pair of counts (of bit 0 and of bit 1)."""
    pair = counts.reshape(-1, 2).astype(np.float32) + np.float32(PRIOR)
    return np.clip(np.rint(np.log(pair[:, 1] / pair[:, 0]) * np.float32(SCALE)), -127, 127).astype(np.int8)


class Learner:
    """What one task counts and learns."""

    def __init__(self, code: Code):
        self.code = code
        self.tables = [np.zeros(2 << bits, np.int32) for _, bits in ORDERS]  # both bits' counts side by side
        self.logits = [np.zeros(1 << bits, np.int8) for _, bits in ORDERS]  # what they say, times SCALE
        self.map = np.zeros(2 * 257 * BUCKETS, np.int64)
        self.weights = np.full((GATES, INPUTS), 0.35, np.float32)
        self.seen = self.blocks = 0

    def wanted(self) -> int:
        """How many symbols the next block should have."""
        return min(BLOCK, FIRST << self.blocks)

    def learn(self, texts: list) -> None:
        """Move weights and map by what is counted so far, then count, block by block."""
        for symbols, owner, _ in blocks(texts):
            c = Contexts.of(symbols)
            coded = np.flatnonzero(owner >= 0)
            ranks = self.code.rank.take(symbols.take(coded))
            dealt = Dealt.of(c.key.take(coded), c.hashed[2].take(coded), ranks, STEP)
            many = np.diff(dealt.begins, append=len(coded))
            at, ranks = coded.take(dealt.first), ranks.take(dealt.first)
            after, hashed = symbols.take(at), [h.take(at) for h in c.hashed]
            if self.blocks:
                # In the order of their hashes, so each step has its share of early and late, frequent and rare.
                for i, j in dealt.parts(PART):
                    self.adapt(after[i:j], [h[i:j] for h in hashed], many[i:j])
            for k, h in enumerate(hashed):
                self.count(k, h, after, ranks, many, dealt.edges)
            self.seen += int((self.code.length.take(after) * many).sum())
            self.blocks += 1

    def count(self, k: int, hashed: np.ndarray, symbols: np.ndarray, ranks: np.ndarray, many: np.ndarray, edges: list[int]) -> None:
        """Count each distinct context and symbol of input k once, at the bits of its path, with its number."""
        table, logits, bits = self.tables[k], self.logits[k], ORDERS[k][1]
        if k == 2:  # its contexts, as the table tells them apart, are in order already
            context = hashed >> np.uint32(32 - bits)
            begins = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (symbols[1:] != symbols[:-1]))))
            first, edges = begins, np.searchsorted(begins, edges).tolist()
        else:
            share = max(0, round(math.log2(len(hashed) / COUNTED)))
            context = hashed.astype(np.uint64)
            part = context >> np.uint64(32 - share)
            context ^= part << np.uint64(32 - share)
            context |= (part << np.uint64(9) | ranks.view(np.uint64)) << np.uint64(32 - share)
            context = context << np.uint64(23) | np.arange(len(hashed), dtype=np.uint64)
            context.sort()
            place = (context & np.uint64((1 << 23) - 1)).astype(np.int64)
            context >>= np.uint64(23)
            begins = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            many, first = many.take(place, mode=FREE), place.take(begins, mode=FREE)
            edges = [0, *np.searchsorted(context.take(begins), np.arange(1, 1 << share, dtype=np.uint64) << np.uint64(41 - share)).tolist(), len(begins)]
        n = np.add.reduceat(many, begins).astype(np.int32)
        hashed, symbols = hashed.take(first, mode=FREE), symbols.take(first, mode=FREE)
        for i, j in spans(edges, PART):
            layers = self.code.layers(symbols[i:j])
            at = layers.slots(hashed[i:j], layers.of_nodes(self.code.spread), bits).astype(np.int64)
            np.add.at(table, 2 * at + layers.of_nodes(self.code.bit), layers.of_symbols(n[i:j]))
            logits[at] = logits_of(table.view(np.int64).take(at, mode=FREE).view(np.int32))

    def adapt(self, symbols: np.ndarray, hashed: list[np.ndarray], many: np.ndarray) -> None:
        """Predict with what is counted so far; move the weights along the error, and the map."""
        layers = self.code.layers(symbols)
        spread, bit = layers.of_nodes(self.code.spread), layers.of_nodes(self.code.bit)
        logits = [t.take(layers.slots(h, spread, bits), mode=FREE) for t, h, (_, bits) in zip(self.logits, hashed, ORDERS, strict=True)]
        gate, weight = gates(layers.of_nodes(self.code.gate), logits), layers.of_symbols(many.astype(np.float32))
        mix = mixed(self.weights / np.float32(SCALE), gate, logits)
        wrong = np.exp(-mix)
        wrong += np.float32(1)
        wrong = bit - np.reciprocal(wrong, out=wrong)
        wrong *= weight
        total = np.maximum(np.bincount(gate, weight, GATES), 256)
        for k in range(INPUTS):
            self.weights[:, k] += RATE / SCALE * np.bincount(gate, wrong * logits[k], GATES) / total
        self.map += np.bincount(2 * bucket(layers.of_nodes(self.code.base), mix) + bit, weight, len(self.map)).astype(np.int64)


@dataclass
class MixingModel:
    """Tables of logits (times SCALE, a byte each), gated weights and the map; all of fixed size."""

    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray
    map: np.ndarray

    def costs(self, symbols: np.ndarray, hashed: list[np.ndarray]) -> np.ndarray:
        """The bits that each symbol, all in order of rank, costs after its contexts."""
        layers = self.code.layers(symbols)
        spread = layers.of_nodes(self.code.spread)
        logits = [t.take(layers.slots(h, spread, bits), mode=FREE) for t, h, (_, bits) in zip(self.tables, hashed, ORDERS, strict=True)]
        mix = mixed(self.weights / np.float32(SCALE), gates(layers.of_nodes(self.code.gate), logits), logits)
        mix += self.map.take(bucket(layers.of_nodes(self.code.base), mix), mode=FREE)
        mix *= layers.of_nodes(self.code.sign)
        np.exp(mix, out=mix)
        mix += np.float32(1)
        return layers.sums(np.log(mix, out=mix)) / math.log(2)

    def segments(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash of what is before, hash of itself, cost in bits) of every segment, in order; the first of a text comes after 0."""
        found = []
        for symbols, owner, start in blocks(texts):
            c = Contexts.of(symbols)
            coded = np.flatnonzero(owner >= 0)
            dealt = Dealt.of(c.key.take(coded), c.hashed[2].take(coded), self.code.rank.take(symbols.take(coded)), PART)
            at = coded.take(dealt.first)
            after, hashed = symbols.take(at), [h.take(at) for h in c.hashed]
            each = np.concatenate([self.costs(after[i:j], [h[i:j] for h in hashed]) for i, j in dealt.parts(PART)])
            cost = np.zeros(len(symbols))
            cost[coded.take(dealt.place)] = np.repeat(each, np.diff(dealt.begins, append=len(coded)))
            begin = np.flatnonzero(start)
            # What is before an anchor lies within its text, or in the lead of its part.
            anchors = c.anchors
            origin = begin[np.searchsorted(begin, anchors, side="right") - 1]
            inside = (anchors > origin) & (owner.take(anchors) >= 0) & (anchors - origin + np.where(start.take(origin) == 1, LEAD, 0) >= LONG)
            places, which = np.unique(np.concatenate((begin, anchors[inside])), return_index=True)
            cut_off = c.key.take(begin) - (symbols.take(begin) + 1).astype(np.uint64)  # without the symbol itself
            context = np.concatenate((np.where(start[begin] == 2, np.uint64(0), cut_off), c.before[inside])).take(which)
            up, down = powers(len(symbols))
            hashes = np.where(owner >= 0, c.key * up, np.uint64(0))
            found.append((owner.take(places), context, mixed_up(np.add.reduceat(hashes, places) * down.take(places)), np.add.reduceat(cost, places)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The cost of each text with its end, by the short contexts."""
        owner, _, _, cost = self.segments(texts)
        return np.bincount(owner, cost, len(texts))


# -- on Spark


def keep_memory() -> None:
    """Let this worker keep the memory of arrays that it frees: each block needs as much again, and fresh pages cost more than the work on them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, (1 << 31) - 1)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def raw_lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the lower-cased bytes of all texts, where each begins and the last ends); null is the empty text."""
    column = pc.fill_null(column, b"")
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return _LOWER.take(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]), (offsets - offsets[0]).astype(np.int64)


def texts_of(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word's, its text), words in order."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    white = _WHITE.take(data)
    cut = np.ones(len(data) + 1, bool)
    np.not_equal(white[1:], white[:-1], out=cut[1:-1])
    cut[ends] = True
    at = np.flatnonzero(cut).astype(np.int32)
    # Words and what stands between them, which few distinct gaps make up.
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    word = np.flatnonzero(~white.take(at[:-1]))
    return pieces.dictionary, pieces.indices.to_numpy().take(word), np.searchsorted(ends, at.take(word), side="right") - 1


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word (not null)."""
    if not len(words) or words.buffers()[2] is None:
        return np.zeros(len(words), np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    ends = sums.take(offsets)
    return mixed_up((ends[1:] - ends[:-1]) * down.take(offsets[:-1]))


class Known:
    """The values of distinct words, found by a hash and then compared byte by byte."""

    def __init__(self, words: pa.Array, values: np.ndarray):
        hashes = word_hashes(words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words, self.values = hashes.take(order), words.take(pa.array(order)), values.take(order)
        again = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        self.twins = dict(zip(self.words.take(pa.array(again)).to_pylist(), self.values.take(again).tolist(), strict=True))  # all but the first of a hash

    def of(self, words: pa.Array) -> np.ndarray:
        """The value of each word, NaN where it isn't known."""
        out = np.full(len(words), math.nan)
        if not len(self.hashes) or not len(words):
            return out
        hashes = word_hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes.take(at) == hashes)
        at = at.take(met)
        same = pc.equal(words.take(pa.array(met)), self.words.take(pa.array(at))).to_numpy(zero_copy_only=False)
        out[met[same]] = self.values.take(at[same])
        for i in met[~same].tolist():
            out[i] = self.twins.get(words[i].as_py(), math.nan)
        return out


def word_counts(train: DataFrame, text: str) -> tuple[DataFrame, np.ndarray, int]:
    """((word, c) of all training documents, counts of the 257 symbols, number of documents)."""

    def count(batches):
        waiting, size = [], 0
        symbols, docs = np.zeros(257, np.int64), 0

        def rows(kind, word, n):
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), word, pa.array(n, pa.int64())], ["kind", "word", "n"])

        def added_up():
            total = pa.concat_tables(waiting).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return pa.table([total["word"], total["n_sum"]], names=["word", "n"])

        def words_in(table):
            for batch in table.combine_chunks().to_batches(max_chunksize=100_000):
                yield rows(np.zeros(batch.num_rows, np.int32), batch.column(0), batch.column(1))

        for batch in small(batches, 0, rows=1 << 30, size=4 * BLOCK):
            data, ends = raw_lower(batch.column(0))
            found, number, _ = words_of(data, ends)
            many = np.bincount(number, minlength=len(found))
            word = np.flatnonzero(many)  # not a gap
            waiting.append(pa.table([found.take(pa.array(word)), pa.array(many.take(word))], names=["word", "n"]))
            size += len(word)
            symbols[:256] += np.bincount(data, minlength=256)
            docs += batch.num_rows
            if size > 600_000:
                waiting = [added_up()]
                size = len(waiting[0])
                if size > 300_000:
                    yield from words_in(waiting[0])
                    waiting, size = [], 0
        symbols[END] = docs
        if waiting:
            yield from words_in(added_up())
        at = np.flatnonzero(symbols)
        yield rows(at + 1, pa.array([b""] * len(at), pa.binary()), symbols.take(at))

    found = cut(train.select(named(text).cast("binary")).mapInArrow(count, "kind int, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("c")))
    symbols = np.zeros(257, np.int64)
    for r in found.where("kind > 0").select("kind", "c").collect():  # 257 at most
        symbols[r.kind - 1] = r.c
    return found.where("kind = 0").select("word", "c"), symbols, int(symbols[END])


def train_mixing(train: DataFrame, text: str, code: Code) -> MixingModel:
    """Count in every task, add up the tables by blocks, average the weights."""

    def learn(batches):
        keep_memory()
        learner = Learner(code)
        waiting, size = [], 0
        for batch in small(batches, 0):
            for raw in texts_of(*raw_lower(batch.column(0))):
                waiting.append(raw)
                size += len(raw) + 6
                if size >= learner.wanted():
                    learner.learn(waiting)
                    waiting, size = [], 0
        if waiting:
            learner.learn(waiting)
        if not learner.seen:
            return
        parts = [("w", 0, (learner.weights * np.float64(learner.seen)).tobytes(), learner.seen), ("m", 0, learner.map.tobytes(), 0)]
        for i in range(INPUTS):
            for b, some in enumerate(learner.tables[i].reshape(-1, 2 * BLOCK_SLOTS)):
                if some.any():
                    parts.append(("t", (i << 16) + b, some, 0))
        for i in range(0, len(parts), 16):
            kind, block, raw, seen = zip(*parts[i : i + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(block, pa.int32()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary()), pa.array(seen, pa.int64())], ["kind", "block", "raw", "seen"])

    kinds = {"w": (np.float64, GATES * INPUTS), "m": (np.int64, 2 * 257 * BUCKETS), "t": (np.int32, 2 * BLOCK_SLOTS)}

    def merge(batches):
        now, total, seen = None, None, 0

        def done():
            raw = total
            if now[0] == "t":
                raw = logits_of(total)
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["kind", "block", "raw", "seen"])

        for batch in batches:
            for kind, block, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, block) != now:
                    if now:
                        yield done()
                    now, total, seen = (kind, block), np.zeros(1, np.float64 if kind == "w" else np.int64), 0
                of, size = kinds[kind]
                total = total + np.frombuffer(pa.decompress(raw, size * np.dtype(of).itemsize, "zstd"), of)
                seen += n
        if now:
            yield done()

    schema = "kind string, block int, raw binary, seen long"
    rows = train.select(named(text).cast("binary")).mapInArrow(learn, schema).repartition("kind", "block").sortWithinPartitions("kind", "block").mapInArrow(merge, schema).collect()
    tables, weights, counts = [np.zeros(1 << bits, np.int8) for _, bits in ORDERS], np.full((GATES, INPUTS), 0.35, np.float32), np.zeros((257 * BUCKETS, 2))
    for r in rows:  # a byte for each place of the tables at most
        if r.kind == "t":
            tables[r.block >> 16].reshape(-1, BLOCK_SLOTS)[r.block & 0xFFFF] = np.frombuffer(bytes(r.raw), np.int8)
        elif r.kind == "w":
            weights = (np.frombuffer(bytes(r.raw)).reshape(GATES, INPUTS) / r.seen).astype(np.float32)
        else:
            counts = np.frombuffer(bytes(r.raw), np.int64).reshape(-1, 2).astype(np.float64)
    centre = np.tile((np.arange(BUCKETS) - 16) / 2, 257)
    p = 1 / (1 + np.exp(-centre))
    strength = 8.0  # what a place of the map holds before anything is counted
    refined = np.log((counts[:, 1] + strength * p) / (counts[:, 0] + strength * (1 - p)))
    return MixingModel(code, tables, weights, refined.astype(np.float32))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[DataFrame, pa.Array, np.ndarray]:
    """(the rarer words, at most ``most`` words of at most ``FREQUENT_BYTES`` in all that are the most frequent, their counts).

    The bound between them is a power of 2**(1/8), so a histogram of a few hundred rows finds it.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("size")).orderBy(F.desc("level")).collect()
    least, held, size = 1 << 30, 0, 0
    for r in steps:
        held, size = held + r.n, size + r.size
        if held > most or size > FREQUENT_BYTES:
            break
        least = r.level
    top = counts.where(level >= least).toArrow()
    return counts.where(level < least), top.column(0).combine_chunks().cast(pa.binary()), top.column(1).to_numpy()


def score(docs: DataFrame, learn: Column, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document."""
    spark = docs.sparkSession
    train = docs.where(learn)
    words, symbols, n_docs = word_counts(train, text)
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_distinct = totals.n + n_docs, totals.v + (n_docs > 0)
    rare, known, times = frequent_words(words)
    code = Code(*huffman(symbols))
    model = train_mixing(train, text, code)
    held = spark.sparkContext.broadcast((model, Known(known, np.log10(times + 0.5))))
    end_value, floor, unseen = math.log10(n_docs + 0.5), math.log10(n_train + 0.5 * (n_distinct + 1)), math.log10(0.5)
    shaped = docs.select(
        F.monotonically_increasing_id().alias("row"), named(key).alias("doc_id"), held_out.alias("held_out"), F.coalesce(learn, F.lit(False)).alias("learned"),
        named(text).cast("binary").alias("t"),
    )
    schema = extended(
        shaped.drop("t"),
        "n_tokens long, known long, part double, bits double, size long, rare array<struct<word: binary, n: int>>, segments array<struct<context: long, segment: long, bits: float>>",
    )
    def run(batches):
        keep_memory()
        model, values = held.value
        for batch in small(batches, 4, rows=1 << 30, size=BLOCK):
            data, ends = raw_lower(batch.column(4))
            texts = texts_of(data, ends)
            found, number, of = words_of(data, ends)
            v = values.of(found).take(number)
            miss = np.isnan(v)
            missing = np.bincount(of[miss], minlength=len(texts))
            n = np.bincount(of, minlength=len(texts)) + 1
            part = np.bincount(of, np.where(miss, unseen, v), len(texts)) + end_value
            # The words that aren't among the frequent ones, each once for a text with its number.
            rare_at, times = np.unique(of[miss] << 32 | number[miss], return_counts=True)
            left = pa.StructArray.from_arrays([found.take(pa.array(rare_at & 0xFFFFFFFF)), pa.array(times.astype(np.int32))], ["word", "n"])
            left = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare_at >> 32, np.arange(len(texts) + 1)), pa.int32()), left)
            owner, context, segment, bits = model.segments(texts)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            structs = pa.StructArray.from_arrays([pa.array(context.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(bits.astype(np.float32))], ["context", "segment", "bits"])
            arrays = [
                pa.array(n), pa.array(n - 1 - missing + (n_docs > 0)), pa.array(part), pa.array(np.bincount(owner, bits, len(texts))), pa.array(np.diff(ends)), left,
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *arrays], schema.names)

    rows = written(shaped.mapInArrow(run, schema))
    tail = rows.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    met = tail.groupBy("word").agg(F.count(F.lit(1)).alias("texts")).join(rare, "word")  # unseen words end here
    tail = join_keys(tail, met, ["word"], "texts")
    gained = repeated_segments(rows).select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("more_known"), "saved")
    by_row = (
        tail.select("row", (F.col("n") * (F.log10(F.col("c") + 0.5) - unseen)).alias("more"), F.col("n").cast("long").alias("more_known"), F.lit(0.0).alias("saved"))
        .unionByName(gained)
        .groupBy("row")
        .agg(F.sum("more").alias("more"), F.sum("more_known").alias("more_known"), F.sum("saved").alias("saved"))
    )
    total_bits = F.col("bits") - F.coalesce("saved", F.lit(0.0))
    return rows.drop("rare", "segments").join(by_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (-total_bits * math.log10(2)).alias("score"),
        (total_bits / F.greatest(F.col("size"), F.lit(1))).alias("bits_per_byte"),
    )


def repeated_segments(rows: DataFrame) -> DataFrame:
    """(row, saved): the bits that long contexts save (or cost, where a segment isn't what they expect) on each segment after one that was learned.

    ``rows`` has row, learned and segments. A context's and a segment's counts are those of all learned
    texts, less the segment at hand if its own text is one of them.
    """
    each = rows.select("row", F.col("learned").cast("int").alias("own"), F.explode("segments").alias("s")).select("row", "own", "s.context", "s.segment", "s.bits")
    contexts = each.groupBy("context").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("n")).where("total > 0 AND n > 1")
    met = written(join_keys(each, contexts, ["context"], "n"))
    segments = met.groupBy("context", "segment").agg(F.sum("own").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 0 AND n > 1")
    others = met.withColumn("total", F.col("total") - F.col("own")).where("total > 0")
    both = join_keys(others, segments, ["context", "segment"], "n", "left")
    both = both.withColumn("times", F.when(F.col("times").isNull(), F.lit(0)).otherwise(F.col("times") - F.col("own")))
    both = written(both.withColumn("level", F.floor(F.log2("total")).cast("int")))
    # How often a context that occurred so often told what comes: some thirty levels.
    hits = both.where("own = 1").groupBy("level").agg(((F.count_if(F.col("times") > 0) + 0.5) / (F.count(F.lit(1)) + 1)).alias("trust"))
    trusted = both.join(F.broadcast(hits), "level", "left").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    rest = (1 - F.col("trust")) * F.pow(F.lit(2.0), -F.col("bits").cast("double"))
    long = F.when(F.col("times") > 0, -F.log2(rest + F.col("trust") * F.col("times") / F.col("total"))).otherwise(F.col("bits") - F.log2(1 - F.col("trust")))
    return trusted.select("row", (F.col("bits") - long).alias("saved"))
