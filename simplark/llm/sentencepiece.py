"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into units that no piece can span; the units of a batch that haven't been met yet
are encoded together. Units of equal length advance together: at each position the hashes of all
substrings that end there probe the sorted piece keys, the best of the candidates is taken by a
vectorised maximum, and its length is stored as the backpointer.

For a unigram model a candidate's value is the score of the best path before it plus its own. A
BPE model has no path scores: there a prefix has exactly one last piece, the one that its last
piece but one can stand before without merging further, so a candidate's value is its length
where that holds and nothing where it doesn't. Both give the ids of the public library, which
the tests compare with. Characters without a piece become byte pieces, or the unknown piece.

Defined cases: null and empty texts have no ids and decode to the empty text; runs of spaces,
lines and other characters outside the vocabulary survive a round trip where the model has byte
pieces; a text is never cut short, however long; repeated rows are each encoded; paths that tie
take the shorter last piece. A column that has the name of a new one gets ``_in`` after it, and
underscores as long as that is taken too. Only models without a normalisation table are taken.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.llm.common import Memo, extended, fresh, held_by_worker, named, numbered, small, strings

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MEMO = 200_000
LONG = 48
CACHE_BITS = 20


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread code points over 64 bits."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of the rows of ``codes``, the empty one first."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    mixed = mix(codes)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + mixed[:, j]
    return out


def powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.full(n, BASE))).cumprod(dtype=np.uint64)


class PieceModel:
    """What encoding needs of a .model file; small enough to broadcast (its size is the vocabulary's)."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with identity normalisation are read")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't read")
        self.bpe = trainer.model_type == 2
        self.dummy_prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        self.kinds = np.array([p.type for p in proto.pieces])
        self.unknown = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.bytes = [i for i, k in enumerate(self.kinds) if k == BYTE] if (self.kinds == BYTE).any() else None
        self.unknown_text = trainer.unk_surface or " ⁇ "


class Encoder:
    """Encodes and decodes with a model; keeps the ids of units it has met lately."""

    def __init__(self, model: PieceModel):
        self.m = model
        ids = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.by_text = {model.pieces[i]: i for i in ids}
        self.size = len(model.pieces)
        if any(SPACE in x.lstrip(SPACE) for x in self.by_text):
            raise ValueError("pieces that span words aren't read")
        self.loose = "\n" if not any("\n" in x for x in self.by_text) else ""
        if model.bpe:
            self._prepare_bpe()
        texts = [x for x in self.by_text if not model.bpe or x in self.usable]
        self.longest = max(map(len, texts), default=1)
        self.joined = {x[i : i + 2] for x in texts for i in range(len(x) - 1)}
        keys = np.array([prefix_hashes(np.array([[ord(c) for c in x]]))[0, -1] for x in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array([self.by_text[x] for x in texts], np.int64)[order]
        lowest = min((model.scores[i] for i in ids), default=0.0)
        self.score = np.append(model.scores, lowest - 10)  # the last is a character without a piece
        n = self.loose
        self.units = re.compile(f"{SPACE}?[^{SPACE}{n}]+|{SPACE}+(?={SPACE}[^{SPACE}{n}])|{SPACE}+" + (f"|{n}+" if n else "") if model.bpe else f"{SPACE}*[^{SPACE}{n}]+|{SPACE}+" + (f"|{n}+" if n else ""))
        self.memo = Memo(MEMO)
        self.raw = [self._bytes(i) for i in range(self.size)]

    # -- BPE: which pieces can stand side by side

    def _prepare_bpe(self) -> None:
        """For each piece when it is made and of what; the pieces that merging really reaches."""
        m = self.m
        ranked = sorted((x for x in self.by_text if len(x) > 1), key=lambda x: -m.scores[self.by_text[x]])
        self.spaces_tie = {x for x in ranked if not x.strip(SPACE)}
        words = [x for x in ranked if x not in self.spaces_tie]
        values = [m.scores[self.by_text[x]] for x in words]
        if len(set(values)) < len(values) or any(SPACE * 2 in x for x in words) or (words and self.spaces_tie and max(m.scores[self.by_text[x]] for x in self.spaces_tie) >= values[-1]):
            raise ValueError("this BPE model's scores don't order its merges")
        self.time = np.full(self.size + 1, -1, np.int64)
        self.parts = np.full((self.size + 1, 2), -1, np.int64)
        self.usable = {x for x in self.by_text if len(x) == 1}
        rank = {x: r for r, x in enumerate(words)}
        for x in words:
            made = [(c, -1, None) for c in x]
            while len(made) > 1:
                best = min(((rank.get(a[0] + b[0], 1 << 60), i) for i, (a, b) in enumerate(zip(made, made[1:], strict=False))))
                if best[0] == 1 << 60:
                    break
                i = best[1]
                a, b = made[i], made[i + 1]
                made[i : i + 2] = [(a[0] + b[0], max(best[0], a[1], b[1]), (a[0], b[0]))]
            if len(made) == 1:
                t = self.by_text[x]
                self.usable.add(x)
                self.time[t], self.parts[t] = made[0][1], [self.by_text[y] for y in made[0][2]]
        joins = [(self.by_text[x[:i]] * self.size + self.by_text[x[i:]], rank[x]) for x in words for i in range(1, len(x)) if x[:i] in self.by_text and x[i:] in self.by_text]
        joins.sort()
        self.join_keys, self.join_time = np.array([k for k, _ in joins] or [0], np.int64), np.array([r for _, r in joins] or [1 << 60], np.int64)
        self.cache_key, self.cache_ok = np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, bool)

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a[i] and the piece b[i] after it as they are."""
        key = a * (self.size + 1) + b
        slot = (key.astype(np.uint64) * BASE >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        ok = self.cache_ok[slot]
        new = np.flatnonzero(self.cache_key[slot] != key)
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self._stand(a[new][first], b[new][first])
            ok[new] = found[back]
            self.cache_key[slot[new]], self.cache_ok[slot[new]] = key[new], ok[new]
            ok[new] = found[back]
        return ok

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges of both sides, the latest first, and look for a merge across in between."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.size) & (b < self.size))
        x, y = a[at], b[at]
        until = np.full(len(at), 1 << 61)
        while len(at):
            pair = x * self.size + y
            k = np.minimum(np.searchsorted(self.join_keys, pair), len(self.join_keys) - 1)
            across = (self.join_keys[k] == pair) & (self.join_time[k] < until)
            ok[at[across]] = False
            tx, ty = self.time[x], self.time[y]
            on = ~across & ((tx >= 0) | (ty >= 0))
            at, x, y, tx, ty = at[on], x[on], y[on], tx[on], ty[on]
            right = ty >= tx  # of two merges of one kind the left one comes first
            until = np.where(right, ty + 1, tx)  # a merge across is left of the right side's, right of the left side's
            x, y = np.where(right, x, self.parts[x, 1]), np.where(right, self.parts[y, 0], y)
        return ok

    def _spaces(self, n: int) -> list[int]:
        """A run of n spaces under BPE: the leftmost of the best pairs merges first."""
        made = [SPACE] * n
        known = {x: self.m.scores[self.by_text[x]] for x in self.spaces_tie}
        lengths = sorted(map(len, known))
        if n > 64 and lengths and lengths == [1 << k for k in range(1, len(lengths) + 1)] and len(set(known.values())) == 1:
            whole, rest = divmod(n - 64, lengths[-1])  # a run settles into the longest pieces from the left
            head = self._spaces(64 + rest)
            return [self.by_text[SPACE * lengths[-1]]] * whole + head
        while len(made) > 1:
            best = max(((known.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(made, made[1:], strict=False))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            made[i : i + 2] = [made[i] + made[i + 1]]
        return [self.by_text.get(x, self.m.unknown) for x in made]

    # -- Viterbi

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, lengths) that end at each position of the best paths of equally long units.

        A character without a piece is the piece ``size``.
        """
        n, length = codes.shape
        hashes, power = prefix_hashes(codes), powers(self.longest)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, length + 1), self.size, np.int64), np.zeros((n, length + 1), np.int64)
        for j in range(1, length + 1):
            l = np.arange(1, min(j, self.longest) + 1)
            key = hashes[:, j, None] - hashes[:, j - l] * power[l]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            piece = np.where(self.keys[k] == key, self.key_ids[k], -1)
            piece[:, 0] = np.where(piece[:, 0] < 0, self.size, piece[:, 0])
            value = np.where(piece >= 0, best[:, j - l], -np.inf)
            if self.m.bpe:
                r, c = np.nonzero(value > -np.inf)
                inner = l[c] < j
                ok = np.ones(len(r), bool)
                ok[inner] = self.stand(last[r[inner], j - l[c[inner]]], piece[r[inner], c[inner]])
                value = np.full(value.shape, -np.inf)
                value[r[ok], c[ok]] = l[c[ok]]
            else:
                value = value + self.score[piece]
            pick = value.argmax(1)
            rows = np.arange(n)
            best[:, j] = value[rows, pick] if not self.m.bpe else np.where(value[rows, pick] > -np.inf, 0, -np.inf)
            last[:, j], back[:, j] = piece[rows, pick], pick + 1
        return last, back

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """The ids (int32) of each distinct unit."""
        parts = {u: self._split(u) for u in units if len(u) > LONG}
        by_length: dict[int, list[str]] = {}
        for x in {p for u in units for p in parts.get(u, (u,))}:
            by_length.setdefault(len(x), []).append(x)
        done: dict[str, bytes] = {}
        for length, words in by_length.items():
            for i in range(0, len(words), step := max(1, 400_000 // (length * min(length, self.longest)))):
                some = words[i : i + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
                flat, ends = self._follow(*self.viterbi(codes))
                raw, ends = flat.astype(np.int32).tobytes(), (4 * ends).tolist()
                done.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
                for k in np.unique(np.searchsorted(ends, 4 * np.flatnonzero(flat == self.size), side="right")).tolist():
                    done[some[k]] = self._spell(some[k], done[some[k]])
        return {u: b"".join([done[p] for p in parts[u]]) if u in parts else done[u] for u in units}

    def _follow(self, last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all units along their backpointers, one after another, and where each unit's end."""
        n, length = len(last), last.shape[1] - 1
        path, on = np.full((n, length), -1, np.int64), np.arange(n)
        at = np.full(n, length)
        while len(on):
            path[on, at - 1] = last[on, at]
            at = at - back[on, at]
            on, at = on[at > 0], at[at > 0]
        used = path >= 0
        return path[used], used.sum(1).cumsum()

    def _spell(self, unit: str, ids: bytes) -> bytes:
        """Byte pieces, or the unknown piece, for characters without a piece."""
        out, at = [], 0
        for i in np.frombuffer(ids, np.int32).tolist():
            if i < self.size:
                out.append(i)
                at += len(self.m.pieces[i])
            else:
                out += [self.m.bytes[b] for b in unit[at].encode("utf-8", "replace")] if self.m.bytes else [self.m.unknown]
                at += 1
        return np.array(out, np.int32).tobytes()

    def _split(self, unit: str) -> list[str]:
        """Where a long unit has two characters that no piece holds side by side, it falls apart."""
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.joined), len(unit)]
        return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    # -- texts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        prefix = SPACE if self.m.dummy_prefix else ""
        cut = [self.units.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        memo, out = self.memo.covering(set().union(*cut), self._make), []
        for us, text in zip(cut, texts, strict=True):
            if self.m.bpe and text and (SPACE * 2 in text or "  " in text or (prefix and text[0] in (" ", SPACE))):
                out.append(np.frombuffer(b"".join(self._with_runs(us, memo)), np.int32))
            else:
                out.append(np.frombuffer(b"".join(map(memo.__getitem__, us)), np.int32))
        return out

    def _make(self, units: list[str]):
        runs = {u for u in units if self.m.bpe and len(u) > 1 and not u.strip(SPACE)}
        yield from ((u, np.array(self._spaces(len(u)), np.int32).tobytes()) for u in runs)
        yield from self.encode_units([u for u in units if u not in runs]).items()

    def _with_runs(self, units: list[str], memo: dict[str, bytes]):
        """A space that its word leaves alone joins the run before it."""
        lone = np.array([self.by_text.get(SPACE, -1)], np.int32).tobytes()
        run = 0
        for u in units:
            if not u.strip(SPACE):
                run = len(u)
                continue
            ids = memo[u]
            if run:
                joins = u[0] == SPACE and ids[:4] == lone
                yield np.array(self._spaces(run + joins), np.int32).tobytes()
                ids, run = ids[4 * joins :], 0
            yield ids
        if run:
            yield np.array(self._spaces(run), np.int32).tobytes()

    def _bytes(self, i: int) -> bytes:
        kind = self.m.kinds[i]
        if kind == BYTE:
            return bytes([int(self.m.pieces[i][3:5], 16)])
        if kind == UNKNOWN:
            return self.m.unknown_text.encode()
        return b"" if kind == CONTROL else self.m.pieces[i].replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if self.m.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encoder_of(held) -> Encoder:
    """One encoder for each Python worker, so that its memo lasts over tasks."""
    return held_by_worker(("sentencepiece", held.id), lambda: Encoder(held.value))


class _Held:
    """A broadcast model with an id that is the same in every worker."""

    def __init__(self, spark: SparkSession, model: PieceModel):
        self.broadcast, self.id = spark.sparkContext.broadcast(model), zlib.crc32("\0".join(model.pieces).encode())

    @property
    def value(self) -> PieceModel:
        return self.broadcast.value


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (all by default) and, of each document: ids, n_ids, decoded (the text of the ids), round_trip.

    round_trip says whether decoding gives back the text (null: the empty text).
    """
    spark = docs.sparkSession
    held = _Held(spark, PieceModel(model_path))
    keep = docs.columns if keep is None else keep
    new = ["ids", "n_ids", "decoded", "round_trip"]
    names: list[str] = []
    for c in keep:
        names.append(fresh(f"{c}_in", keep, new, names) if c.lower() in new else c)
    kept = docs.select(*[named(c).alias(n) for c, n in zip(keep, names, strict=True)])
    out = docs.select(*[named(c).alias(n) for c, n in zip(keep, names, strict=True)], named(text).alias(fresh("text", names)))
    schema = extended(kept, "ids array<int>, n_ids long, decoded string, round_trip boolean")

    def run(batches):
        encoder = encoder_of(held)
        for batch in small(batches, len(names), rows=1000):
            texts = strings(batch.column(batch.num_columns - 1))
            ids = encoder.encode(texts)
            counts = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int32()))
            decoded = [encoder.decode(x) for x in ids]
            same = [d == (t or "") for d, t in zip(decoded, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(counts), pa.array(decoded, pa.string()), pa.array(same)], schema.names)

    return numbered(out).mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The documents with the text of their ids (null: null); a column ``name`` that they have gives way."""
    spark = docs.sparkSession
    docs = docs.drop(name)
    held = _Held(spark, PieceModel(model_path))
    schema = extended(docs, f"{name} string")
    at = docs.columns.index(ids)

    def run(batches):
        encoder = encoder_of(held)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return numbered(docs).mapInArrow(run, schema)
