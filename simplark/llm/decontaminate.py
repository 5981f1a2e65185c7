"""Benchmark decontamination by template windows.

Texts become templates: numbers, names (capitalised words) and units (after a number) turn into
typed slots. Windows of ``WINDOW`` template tokens of the documents are hash-joined with those of
the benchmark items. A match maps the item's slot values to the document's; along one alignment
of an item and a document each item value must map to one document value of its slot type (two
may share one). Windows with a value that maps to several are dropped, unless they have the
item's own values word for word. What remains is measured by the share of the item's usable windows that the document has.

A second template of each text keeps names as words, so that a copy in another case is found too.
Each of the two forms is measured against its own usable windows, and the larger share counts: a copy
with other names can't match windows that only names as words make usable. Windows with fewer than
``SEED`` ordinary words say too little and aren't used; an alignment needs ``LITERALS`` of them in all
its windows. Items shorter than a window are matched as a whole if they have ``LITERALS`` ordinary words.
Items whose usable windows have fewer than ``LITERALS`` different ordinary words in each of the forms (few words
among numbers, or few tokens) could match in none of them and are looked for as they are, case and punctuation aside: all their tokens in a row, or as the whole document if there are
fewer than ``WHOLE``.
Beside the share, an excerpt is enough: ``RUN`` tokens in a row of one alignment, ``RUN_WORDS`` of
them ordinary words.

Documents drop windows that no item has before anything is shuffled: the items' window hashes are
broadcast in blocks of at most ``BLOCK`` hashes (8 bytes each), with one pass over the documents
for each block, so a large benchmark costs passes and never memory. Matches are joined with the items'
windows by broadcast as long as those are few; of more, those that a very common passage hits are. White
space, punctuation and case don't matter.

Defined cases: null and empty texts and items match nothing; texts are judged each by itself, and
rows that repeat a doc_id are reported together with the largest share among their texts, rows without one
as the doc_id null; an item_id that repeats counts as one item with the windows of all its rows; a
share of exactly ``coverage`` is enough; texts and items count whole, however long; other columns may
have any names; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from simplark.llm.common import HOT_ROWS, checked, cut, extended, fresh, held_by_worker, named, small, strings, written

WINDOW = 8
SEED = 2
LITERALS = 5
COVERAGE = 0.5
RUN = 14
RUN_WORDS = 8
BLOCK = 4_000_000
#: Windows of items (with their slots some hundred bytes each) that are broadcast.
BROADCAST_WINDOWS = 100_000
TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
#: Unit words that are slots after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh meter meters metre metres "
    "kilometer kilometers centimeter centimeters".split()
)
NUMBER, NAME, UNIT, WORD = range(4)
#: The forms of a text: names as slots, names as words, and every token as it is.
NAMES_AS_SLOTS, NAMES_AS_WORDS, LITERAL = "slots", "words", "literal"
#: Tokens of an item that may stand inside a document when no template window of it is usable; shorter ones must be all of it.
WHOLE = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
MEMO = 150_000


class Tokens(dict):
    """Numbers of the distinct tokens met so far; what they are stands in arrays."""

    def __init__(self):
        super().__init__()
        self.texts: list[str] = []
        self.kind = np.zeros(1 << 12, np.int8)
        self.unit = np.zeros(1 << 12, bool)
        self.hash = np.zeros(1 << 12, np.uint64)

    def __missing__(self, token: str) -> int:
        k = len(self.texts)
        if k == len(self.kind):
            self.kind, self.unit, self.hash = (np.concatenate((x, np.zeros_like(x))) for x in (self.kind, self.unit, self.hash))
        low = token.lower()
        self.texts.append(low)
        self.kind[k] = NUMBER if token[0].isdigit() else NAME if token[0].isupper() and len(token) > 1 else WORD
        self.unit[k] = low in UNITS
        self.hash[k] = xxh64_intdigest(low.encode("utf-8", "replace"))
        self[token] = k
        return k


def templates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(document starts, token numbers, their texts, {form: (template hashes, is a slot)})."""
    known: Tokens = held_by_worker("decontaminate", Tokens)
    if len(known) > MEMO:
        known.__init__()
        known.clear()
    found = [TOKEN.findall(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in found])))
    get = known.__getitem__
    ids = np.fromiter((get(w) for ws in found for w in ws), np.int64, starts[-1])
    kind = known.kind[ids]
    number = kind == NUMBER
    unit = np.zeros(len(ids), bool)
    if len(ids):
        unit[1:] = known.unit[ids[1:]] & number[:-1]
        unit[starts[:-1][starts[:-1] < len(ids)]] = False
    low = known.hash[ids]
    fixed = np.where(number, np.uint64(1), np.where(unit, np.uint64(2), low))
    slot = number | unit
    name = (kind == NAME) & ~unit
    forms = [(np.where(name, np.uint64(3), fixed), slot | name), (fixed, slot), (low, np.zeros(len(ids), bool))]
    return starts, ids, known.texts, dict(zip((NAMES_AS_SLOTS, NAMES_AS_WORDS, LITERAL), forms, strict=True))


def slot_values(words: list[str], ids: np.ndarray, h: np.ndarray, slot: np.ndarray) -> list[str]:
    """The values of a window's slots, each behind its type (1 number, 2 unit, 3 name)."""
    return [f"{kind}:{words[i]}" for i, kind in zip(ids[slot].tolist(), h[slot].tolist(), strict=True)]


def window_hashes(h: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window by its first token, and whether it has enough ordinary words."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * STEP
        out ^= out >> np.uint64(31)
    words = np.concatenate(([0], np.cumsum(~slot)))
    return out, words[width:][:n] - words[:n] >= (SEED if width == WINDOW else LITERALS)


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, width, form, hash, item_pos, item_slots, item_words, n_windows, n_tokens) of every usable window of every item.

    ``item_words`` are the places of its ordinary words, ``n_windows`` is how many windows the item has in
    this form. The literal form is there only for items that could match in no other: it stands in their place.
    """
    shaped = items.select(named(key).alias("item_id"), named(text).alias("t"))
    schema = extended(
        shaped.select("item_id"), "width int, form string, hash long, item_pos int, item_slots array<string>, item_words array<int>, n_windows int, n_tokens int"
    )

    def run(batches):
        for batch in small(batches, 1):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                starts, ids, words, forms = templates([text or ""])
                width = min(WINDOW, len(ids))
                before, most = len(rows), 0
                for form, (h, slot) in forms.items() if width else ():
                    hashes, ok = window_hashes(h, slot, width)
                    if form == LITERAL:
                        if most >= LITERALS:
                            continue
                        del rows[before:]
                        ok[:] = True
                    elif width < LITERALS or (~slot).sum() < LITERALS:  # no alignment can have enough
                        continue
                    covered = np.zeros(len(ids), bool)
                    for k in range(width):
                        covered[k : k + len(ok)] |= ok
                    most = max(most, int((covered & ~slot).sum()))
                    for p in np.flatnonzero(ok).tolist():
                        values = slot_values(words, ids[p : p + width], h[p : p + width], slot[p : p + width])
                        plain = (p + np.flatnonzero(~slot[p : p + width])).tolist()
                        rows.append((item, width, form, int(hashes[p : p + 1].view(np.int64)[0]), p, values, plain, int(ok.sum()), len(ids)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow(schema))

    return shaped.mapInArrow(run, schema)


def to_arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def text_row(text: str) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(named(text))


def document_hits(docs: DataFrame, hashes: np.ndarray, widths: list[tuple[str, int]], key: str, text: str) -> DataFrame:
    """The documents' windows of these (form, width)s whose hash is among ``hashes`` (sorted, at most BLOCK)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(hashes)
    shaped = docs.select(named(key).alias("doc_id"), named(text).alias("t"), text_row(text).alias("row"))
    schema = extended(shaped.select("doc_id", "row"), "width int, form string, hash long, doc_pos int, doc_slots array<string>, doc_tokens int")
    bits = 24

    def run(batches):
        known = held.value
        maybe = np.zeros(1 << bits, bool)
        maybe[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        arrow = to_arrow(schema)

        def among(h):
            at = np.flatnonzero(maybe[(h >> np.uint64(64 - bits)).astype(np.int64)])
            k = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            return at[known[k] == h[at]]

        for batch in small(batches, 1):
            keys, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            starts, ids, words, forms = templates([x or "" for x in strings(batch.column(1))])
            rows = []
            for form, width in widths:
                h, slot = forms[form]
                hashes, ok = window_hashes(h, slot, width)
                at = among(hashes)
                if form != LITERAL:
                    at = at[ok[at]]
                owner = np.searchsorted(starts, at, side="right") - 1
                inside = at + width <= starts[owner + 1]
                at, owner = at[inside], owner[inside]
                for p, o, x in zip(at.tolist(), owner.tolist(), hashes[at].view(np.int64).tolist(), strict=True):
                    values = slot_values(words, ids[p : p + width], h[p : p + width], slot[p : p + width])
                    rows.append((keys[o], numbers[o], width, form, x, p - int(starts[o]), values, int(starts[o + 1] - starts[o])))
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 20_000]], schema=arrow)

    return shaped.mapInArrow(run, schema)


def consistent(windows: list[dict]) -> list[dict]:
    """The windows of one alignment without those whose item values map to several document values, unless all their values are the item's."""
    values: dict[str, set[str]] = {}
    for w in windows:
        for a, b in zip(w["item_slots"], w["doc_slots"], strict=True):
            values.setdefault(a, set()).add(b)
    return [w for w in windows if w["item_slots"] == w["doc_slots"] or all(len(values[a]) == 1 for a in w["item_slots"])]


def evidence(windows: list[dict], form: str) -> tuple[list[int], bool, bool]:
    """(places of the matched windows, whether there is an excerpt of RUN tokens, whether no value differs) of one alignment."""
    if form == LITERAL:
        places = sorted({w["item_pos"] for w in windows})
        return places if len(places) == windows[0]["n_windows"] else [], False, True
    windows = sorted(consistent(windows), key=lambda w: w["item_pos"])
    runs: list[list] = []  # [first token, token after the last, ordinary words]
    for w in windows:
        at, end = w["item_pos"], w["item_pos"] + w["width"]
        if not runs or at > runs[-1][1]:
            runs.append([at, end, set()])
        runs[-1][1] = max(end, runs[-1][1])
        runs[-1][2].update(w["item_words"])
    if sum(len(x) for _, _, x in runs) < LITERALS:
        return [], False, True
    excerpt = any(end - at >= RUN and len(x) >= RUN_WORDS for at, end, x in runs)
    return sorted({w["item_pos"] for w in windows}), excerpt, all(w["item_slots"] == w["doc_slots"] for w in windows)


def alignments(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, form, places, excerpt, verbatim) of each alignment; its windows are as many as the item's at most."""
    shift = (F.col("doc_pos") - F.col("item_pos")).alias("shift")
    windows = F.collect_set(F.struct("width", "item_pos", "item_slots", "doc_slots", "item_words", "n_windows")).alias("windows")
    fits = (F.size("item_slots") == F.size("doc_slots")) & ((F.col("form") != LITERAL) | (F.col("n_tokens") >= WHOLE) | (F.col("n_tokens") == F.col("doc_tokens")))
    grouped = found.where(fits).groupBy("doc_id", "row", "item_id", "form", shift).agg(windows).drop("shift")
    schema = extended(grouped.drop("windows"), "places array<int>, excerpt boolean, verbatim boolean")

    def run(batches):
        for batch in batches:
            made = [evidence(x, form) for x, form in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            places, excerpt, verbatim = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(places, pa.list_(pa.int32())), pa.array(excerpt, pa.bool_()), pa.array(verbatim, pa.bool_())], schema.names)

    return grouped.mapInArrow(run, schema).where(F.size("places") > 0)


def with_windows(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """The documents' matches with the items' windows; no hash that many rows share meets in one task."""
    keys = ["width", "form", "hash"]
    if windows.count() <= BROADCAST_WINDOWS:
        return hits.join(F.broadcast(windows), keys)
    hits = written(hits)
    hot = cut(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).select(*keys))
    of_hot = windows.join(F.broadcast(hot), keys)  # at most one for each HOT_ROWS matches
    of_hot = F.broadcast(of_hot) if of_hot.count() <= BROADCAST_WINDOWS else of_hot
    rest = hits.join(F.broadcast(hot), keys, "left_anti").join(windows, keys)
    return hits.join(F.broadcast(hot), keys, "left_semi").join(of_hot, keys).unionByName(rest)


def contaminated_rows(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, row (a number of the text), item_id, coverage, n_windows, verbatim of each text with at least ``coverage`` of an item's windows, or an excerpt of it.

    Coverage and windows are those of the form that matches more. An excerpt's coverage may be below ``coverage``.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(items, item_key, item_text))
    blocks = cut(windows.select("hash").distinct().select("hash", F.lit(0).alias("block")))
    n = blocks.count()
    passes = max(1, -(-n // BLOCK))
    widths = sorted((r.form, r.width) for r in windows.select("form", "width").distinct().collect())  # at most WINDOW for each form
    hits = []
    for k in range(passes):
        some = blocks.where((F.xxhash64("hash") % passes + passes) % passes == k).select("hash").toPandas()["hash"].to_numpy(np.int64)
        if len(some):
            hits.append(document_hits(docs, np.sort(some.view(np.uint64)), widths, key, text))
    sizes = windows.groupBy("item_id", "form").agg(F.max("n_windows").alias("of"))
    if not hits:
        hits.append(document_hits(docs.limit(0), np.zeros(1, np.uint64), [], key, text))
    found = with_windows(reduce(DataFrame.unionByName, hits), windows)
    by_form = (
        alignments(found)
        .groupBy("doc_id", "row", "item_id", "form")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.max("excerpt").alias("excerpt"), F.min("verbatim").alias("verbatim"))
        .join(sizes, ["item_id", "form"])
        .withColumn("best", F.struct((F.col("n_windows") / F.col("of")).alias("coverage"), "n_windows"))
    )
    return (
        by_form.groupBy("doc_id", "row", "item_id")
        .agg(F.max("best").alias("best"), F.max("excerpt").alias("excerpt"), F.min("verbatim").alias("verbatim"))
        .where((F.col("best.coverage") >= coverage) | F.col("excerpt"))
        .select("doc_id", "row", "item_id", "best.coverage", "best.n_windows", "verbatim")
    )


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_windows, verbatim of each document with a contaminated text; of several texts the one with the largest share counts."""
    found = contaminated_rows(docs, items, key, text, item_key, item_text, coverage)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_windows", "verbatim")).alias("best"))
    return best.select("doc_id", "item_id", "best.coverage", "best.n_windows", "best.verbatim")


def keep_clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The documents whose text isn't contaminated, all columns as they are; a doc_id, or its lack, saves or dooms no other text."""
    found = contaminated_rows(docs, items, key, text, coverage=coverage)
    gone, row = fresh("gone", docs.columns), fresh("row", docs.columns)
    drop = checked(found.select(F.col("doc_id").alias(gone), F.col("row").alias(row)).distinct())
    return docs.join(drop, named(key).eqNullSafe(F.col(gone)) & (text_row(text) == F.col(row)), "left_anti")
