"""Benchmark decontamination by template windows.

Words of a text become a template: numbers, names (capitalised words that start
no sentence) and units (unit words behind a number) turn into typed
placeholders, all else into lower case without outer punctuation. Windows of
``WIDTH`` template words are hashed and joined with the windows of the
benchmark items by their hashes. Windows that match along one diagonal (the same
distance between their places in document and item) are one occurrence; there
the values in the slots must correspond one to one, which keeps re-parameterised
questions and lets go of text that merely shares a template. Windows with slots
are joined by their plain words as well, whatever their case, so no window
of an item is left out (where fewer than ``LITERAL`` words are literal only
equal words match) and copies in small or capital letters are found.

An occurrence counts from ``LEAST`` windows on (13 words in a row), or all of
an item that has fewer (of its windows with enough literals, where slots have
other values); items shorter than a window are one window, and items shorter
than ``SHORT`` words occur only as a whole text. Where slots of a
diagonal conflict, its windows with equal words still count from ``LEAST`` on,
and so does a stretch of ``LONG`` adjoining windows without a conflict.

1. The items' windows become a table, and their hashes a Bloom filter of at
   most ``BLOCK`` bits, which goes along with the tasks.
2. One pass over the documents emits the windows that pass the filter, with the
   values of their slots; a fuller filter lets more pass and changes no result.
3. Both tables are joined by hash. Spark broadcasts the items' side below its
   own threshold (spark.sql.autoBroadcastJoinThreshold) and shuffles beyond it.
4. Matched windows are gathered by text, item and diagonal: no more than the
   item has windows. Slots are judged there. Texts are named by their digest,
   so equal texts are judged once and no document's key can be hot.

``Items`` does the same for a few items and texts at hand, without tables.

* Null and empty texts match nothing; items without words are left out.
* Repeated documents each get their rows; repeated items are told apart by
  item_id and text only. Empty tables give no rows.
* Only doc_id and text, item_id and text are read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.batches import Codes, map_batches, mixed, stored

WIDTH, LEAST, LONG = 10, 4, 30
#: Words in a window that must be no placeholders, for its slots to have other values.
LITERAL = 6
#: Items of fewer words occur only as whole texts.
SHORT = 3
#: Bits of the Bloom filter at most, bits for each hash below that, and probes.
BLOCK, BITS_EACH, PROBES = 1 << 26, 16, 4
#: Characters of texts that are taken together; a longer text is taken alone.
TOGETHER = 1_000_000
_NAME, _ENDS, _NUMBER, _UNIT = (np.uint64(1 << k) for k in (63, 62, 61, 60))
_LOW = np.uint64((1 << 60) - 1)
_NUMBER_OF = re.compile(r"[+-]?[$€£¥]?\d[\d.,:/]*(%|°|[a-zµ]{1,3})?$")
_EDGE = re.compile(r"^[^\w$€£¥+-]+|[^\w%°]+$")
#: Unit words.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros volt volts watt watts joule joules newton newtons meter meters metre metres kilometer kilometers kilometre kilometres mph kmh hz khz mhz ghz kb mb gb".split())
#: How windows are found: as templates, as plain words.
_ALIKE, _SAME = 1, 2


def _code(word: str) -> int:
    """Hash and flags of a word; 0 for punctuation alone."""
    if word.isalpha():
        low = word.lower()
        code = xxhash.xxh64_intdigest(word.casefold().encode("utf-8", "surrogatepass")) & int(_LOW) | 1
        return code | (int(_UNIT) if low in UNITS else int(_NAME) if word[0].isupper() and word[1:2].islower() else 0)
    core = _EDGE.sub("", word)
    if not core or not any(c.isalnum() for c in core):
        return int(_ENDS) if word[-1] in ".!?" else 0
    low = core.lower()
    code = xxhash.xxh64_intdigest(core.casefold().encode("utf-8", "surrogatepass")) & int(_LOW) | 1
    if word.rstrip("\"')]}*%$&#")[-1:] in tuple(".!?:"):
        code |= int(_ENDS)
    if _NUMBER_OF.fullmatch(low):
        code |= int(_NUMBER)
    elif low in UNITS:
        code |= int(_UNIT)
    elif core[0].isupper() and core[1:2].islower():
        code |= int(_NAME)
    return code


_PLACE = {k: np.uint64(xxhash.xxh64_intdigest(k) & int(_LOW)) for k in ("number", "name", "unit")}
_codes = Codes(__name__, _code)
_BASE = 0x9E3779B97F4A7C15
#: Powers of the base of window hashes, and of its inverse; longer ones for longer texts.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums of codes times powers, from which windows of any width have their hash in one step."""
    if len(codes) >= len(_powers[0]):
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * len(codes), base, np.uint64))))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers[0][1 : len(codes) + 1], out=out[1:])
    return out


def _windows(sums: np.ndarray, n: int) -> np.ndarray:
    """What ``batches.windows`` gives for the codes with these sums."""
    return mixed((sums[n:] - sums[:-n]) * _powers[1][: len(sums) - n] + np.uint64(n))


class Texts:
    """The templates of texts, side by side: codes of their words, their kinds (0: literal), and which text each word is of."""

    def __init__(self, texts: list[str | None]):
        split = [text.split() if text else [] for text in texts]
        all_codes = _codes.array([w for x in split for w in x])
        ends = (all_codes & _ENDS) != 0
        at = np.flatnonzero(all_codes & _LOW)
        codes = all_codes[at]
        self.of = np.repeat(np.arange(len(split)), list(map(len, split)))[at]
        #: Of each text its number of words, and where they begin.
        self.lengths = np.bincount(self.of, minlength=len(split))
        self.first = np.cumsum(self.lengths) - self.lengths
        inside = self.of[1:] == self.of[:-1]
        # A sentence starts at the first word and behind a word, or lone sign, that ends one.
        ended = np.concatenate(([0], np.cumsum(ends)))
        starts = np.ones(len(at), bool)
        starts[1:] = (ended[at[1:]] > ended[at[:-1]]) | ~inside
        number = (codes & _NUMBER) != 0
        unit = (codes & _UNIT) != 0
        unit[:1] = False
        unit[1:] &= number[:-1] & inside
        name = ((codes & _NAME) != 0) & ~starts
        self.kinds = (number * 1 + unit * 2 + name * 3).astype(np.uint8)
        self.plain = codes & _LOW
        self.codes = np.where(number, _PLACE["number"], np.where(unit, _PLACE["unit"], np.where(name, _PLACE["name"], self.plain)))
        self._of_codes = _sums(self.codes)
        self._of_plain = _sums(self.plain) if self.kinds.any() else self._of_codes

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows of ``n`` words within one text begin, and their hashes as templates and as plain words; equal where there is no slot."""
        if len(self.of) < n:
            return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.of[n - 1 :] == self.of[: len(self.of) - n + 1])
        if n < SHORT:
            at = at[self.lengths[self.of[at]] == n]
        own = _windows(self._of_codes, n)[at]
        return at, own, own if self._of_plain is self._of_codes else _windows(self._of_plain, n)[at]

    def telling(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of windows of ``n`` words, whether enough of them are literal."""
        sums = np.concatenate(([0], np.cumsum(self.kinds == 0)))
        return sums[at + n] - sums[at] >= min(LITERAL, n)


class Template(Texts):
    """The template of one text."""

    def __init__(self, text: str | None):
        super().__init__([text])
        self.width = min(WIDTH, len(self.codes))


#: Of each place of an item that is a slot: its kind, the item's value and the document's.
Slots = dict[int, tuple[int, int, int]]


def _slots(doc: Texts, item: Texts, shift: int, places: list[int], width: int) -> Slots:
    at = sorted({p + j for p in places for j in range(width)})
    return {k: (int(item.kinds[k]), int(item.plain[k]), int(doc.plain[k + shift])) for k in at if item.kinds[k]}


def consistent(slots: Slots, places: list[int], width: int) -> bool | None:
    """Whether all slots of the windows at these places have equal values; None if values don't correspond one to one."""
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    equal = True
    inside = {p + j for p in places for j in range(width)}
    for k, (kind, a, b) in slots.items():
        if k in inside:
            if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return None
            equal &= a == b
    return equal


def stretches(slots: Slots, places: list[int], width: int) -> Iterator[tuple[int, int]]:
    """The longest stretches (first, last + 1) of adjoining windows whose slots correspond one to one."""
    cuts = [0, *(k for k in range(1, len(places)) if places[k] != places[k - 1] + 1), len(places)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        start, end = places[a], places[b - 1] + width
        # Of each value its newest partner, that one's newest place, and the newest place of any other partner.
        seen: dict[tuple[bool, int, int], tuple[int, int, int]] = {}
        for k in range(start, end):
            if k not in slots:
                continue
            (kind, there, here), conflict = slots[k], -1
            for back, value, partner in ((False, there, here), (True, here, there)):
                newest, at, other = seen.get((back, kind, value), (partner, -1, -1))
                if newest != partner:
                    other = at
                seen[back, kind, value] = (partner, k, other)
                conflict = max(conflict, other)
            if conflict >= start:
                yield start, max(start, k - width + 1)
                start = conflict + 1
        yield start, max(start, end - width + 1)


def judged(found: dict[int, int], slots: Slots, width: int, total: int, telling: int) -> tuple[int, bool]:
    """Windows of an item's occurrence along a diagonal (0: none), whether all slots are equal. found: how each window of the item was found."""
    least = min(LEAST, total)
    every, same, alike = (sorted(p for p, kind in found.items() if kind & of) for of in (_ALIKE | _SAME, _SAME, _ALIKE))
    best = (0, False)
    for some, enough in ((every, least), (same, least), (alike, min(LEAST, telling))):
        if some and len(some) >= enough:
            equal = consistent(slots, some, width)
            if equal is not None:
                best = max(best, (len(some), equal))
    if len(every) >= LONG:
        for first, last in stretches(slots, every, width):
            if last - first >= LONG:
                best = max(best, (last - first, bool(consistent(slots, list(range(first, last)), width))))
    return best


def entries(items: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """Of each item with words: its number, its width, hashes, places and kinds of its entries, its windows, and those with enough literals."""
    for n in np.unique(np.minimum(items.lengths, WIDTH)).tolist():
        if not n:
            continue
        at, own, plain = items.windows(n)
        of = items.of[at]
        mine = np.minimum(items.lengths, WIDTH)[of] == n
        at, own, plain, of = at[mine], own[mine], plain[mine], of[mine]
        telling, slots = items.telling(at, n), own != plain
        cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            k, here = int(of[a]), slice(a, b)
            places = at[here] - items.first[k]
            parts = [(own[here], telling[here] & slots[here], _ALIKE), (plain[here], slots[here], _SAME), (own[here], ~slots[here], _ALIKE | _SAME)]
            hashes, where, kinds = (np.concatenate(x) for x in zip(*((h[m], places[m], np.full(m.sum(), kind, np.uint8)) for h, m, kind in parts), strict=True))
            yield k, n, hashes, where, kinds, b - a, int(telling[here].sum())


class Items:
    """A hash table of items at hand: (item_id, text)."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows
        self.templates = [Template(text) for _, text in rows]
        #: Of each item its windows, and those with enough literals.
        self.total, self.telling = [0] * len(rows), [0] * len(rows)
        self.at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for _, _, hashes, places, kinds, self.total[k], self.telling[k] in entries(t):
                for h, place, kind in zip(hashes.tolist(), places.tolist(), kinds.tolist(), strict=True):
                    self.at[h].append((k, place, kind))
        self.widths = sorted({t.width for t in self.templates if t.width})

    def matches(self, text: str | None) -> list[tuple[int, int, float, bool]]:
        """Of each item that occurs in a text: item_id, windows of its best occurrence, their share, whether all slots are equal."""
        doc = Template(text)
        along: dict[tuple[int, int], dict[int, int]] = defaultdict(dict)
        for n in self.widths:
            at, own, plain = doc.windows(n)
            for d, *hashes in zip(at.tolist(), own.tolist(), plain.tolist(), strict=True):
                for h in set(hashes):
                    for item, place, kind in self.at.get(h, ()):
                        places = along[item, d - place]
                        places[place] = places.get(place, 0) | kind
        best: dict[int, tuple[int, bool]] = {}
        for (item, shift), places in along.items():
            t = self.templates[item]
            n, equal = judged(places, _slots(doc, t, shift, list(places), t.width), t.width, self.total[item], self.telling[item])
            if n:
                best[item] = max(best.get(item, (0, False)), (n, equal))
        return [(self.rows[k][0], n, n / self.total[k], equal) for k, (n, equal) in sorted(best.items())]

    @staticmethod
    def _stretches(doc: Texts, item: Texts, shift: int, places: list[int]) -> Iterator[tuple[int, int]]:
        return stretches(_slots(doc, item, shift, places, item.width), places, item.width)

    @staticmethod
    def _consistent(doc: Texts, item: Texts, shift: int, places: list[int]) -> bool | None:
        return consistent(_slots(doc, item, shift, places, item.width), places, item.width)


# Tables


def _together(texts: list[str | None]) -> Iterator[tuple[int, Texts]]:
    """The texts in groups of bounded size, each with the number of its first."""
    first = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > first and size + n > TOGETHER:
            yield first, Texts(texts[first:k])
            first, size = k, 0
        size += n
    if first < len(texts):
        yield first, Texts(texts[first:])


def _values(of: np.ndarray, at: np.ndarray, n: int) -> list[bytes]:
    """Of each window of ``n`` words its numbers, as bytes."""
    data, size = of[at[:, None] + np.arange(n)].tobytes(), n * of.itemsize
    return [data[k : k + size] for k in range(0, len(data), size)]


def _digest(text: str) -> str:
    """What Spark's md5 gives for a text."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item (item_id and the text's digest), item_id, width, total, telling, hash, place, kind, kinds, theirs (values) of every entry."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    schema = "item string, item_id long, width int, total int, telling int, hash long, place int, kind int, kinds binary, theirs binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts, columns = batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), [[] for _ in range(10)]
        for first, some in _together(texts):
            for k, n, hashes, places, kinds, total, telling in entries(some):
                at = places + some.first[k]
                item = f"{ids[first + k]}:{_digest(texts[first + k])}"
                new = ([item] * len(at), [ids[first + k]] * len(at), [n] * len(at), [total] * len(at), [telling] * len(at), hashes.view(np.int64).tolist(), places.tolist(), kinds.tolist(), _values(some.kinds, at, n), _values(some.plain, at, n))
                for column, values in zip(columns, new, strict=True):
                    column += values
        if not columns[0]:
            return None
        types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return map_batches(rows, run, schema)


def bloom(windows: DataFrame, block: int) -> np.ndarray:
    """A Bloom filter of the windows' hashes, in words of 64 bits; about ``block`` bits at most come to the driver."""
    hashes = windows.select("hash").distinct()
    bits, enough = 1 << 10, min(block, BITS_EACH * hashes.count())
    while bits < enough:
        bits *= 2
    step = F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(F.col("hash").bitwiseAND(F.lit(bits - 1)) + step * k).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The places of hashes that the filter may hold."""
    at, last = np.arange(len(hashes)), np.uint64(len(bits) * 64 - 1)
    for k in range(PROBES):
        h = hashes[at]
        bit = ((h & last) + ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(k)) & last
        at = at[(bits[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)) != 0]
    return at


def document_windows(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """text (digest), hash, place, ours (values, if there are slots) of every window that the filter may hold; and a row with doc_id and text, without hash, of each document that has such windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, texts, columns = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), [[] for _ in range(5)]
        for first, some in _together(texts):
            names: dict[int, str] = {}
            for n in widths:
                at, own, plain = some.windows(n)
                slots = np.flatnonzero(own != plain)
                for hashes, here, valued in ((own, None, True), (plain[slots], slots, False)):
                    found = _passing(hashes, bits)
                    places = at[found if here is None else here[found]]
                    of = some.of[places].tolist()
                    for k in set(of) - names.keys():
                        names[k] = _digest(texts[first + k])
                        for column, value in zip(columns, (ids[first + k], names[k], None, None, None), strict=True):
                            column.append(value)
                    values: list[bytes | None] = [None] * len(of)
                    if valued and len(of):
                        values = [v if s else None for v, s in zip(_values(some.plain, places, n), (own[found] != plain[found]).tolist(), strict=True)]
                    new = ([None] * len(of), [names[k] for k in of], hashes[found].view(np.int64).tolist(), (places - some.first[of] if of else places).tolist(), values)
                    for column, more in zip(columns, new, strict=True):
                        column += more
        if not columns[0]:
            return None
        types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "name", "hash", "place", "ours"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, name string, hash long, place int, ours binary")


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    rows = []
    for r in batch.to_pylist():
        found: dict[int, int] = {}
        slots: Slots = {}
        for w in r["windows"]:
            place = w["place"]
            found[place] = found.get(place, 0) | w["kind"]
            if any(w["kinds"]):
                theirs = np.frombuffer(w["theirs"], np.uint64).tolist()
                ours = theirs if w["ours"] is None else np.frombuffer(w["ours"], np.uint64).tolist()
                slots |= {place + j: (kind, theirs[j], ours[j]) for j, kind in enumerate(w["kinds"]) if kind}
        n, equal = judged(found, slots, r["width"], r["total"], r["telling"])
        if n:
            rows.append((r["name"], r["item"], r["item_id"], n, n / r["total"], equal))
    if not rows:
        return None
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["name", "item", "item_id", "windows", "share", "exact"])


def occurrences(docs: DataFrame, benchmark: DataFrame, block: int) -> tuple[DataFrame, DataFrame] | None:
    """(doc_id, name) of documents that may match, and (name, item, item_id, windows, share, exact) of each text and item that occurs in it; None without items."""
    items = stored(item_windows(benchmark), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    if not widths:
        return None
    ours = stored(document_windows(docs, bloom(items, block), widths), "windows")
    # Copies have one name and so one row for each window.
    hits = ours.where(F.col("hash").isNotNull()).drop("doc_id").distinct()
    of_item = ("item", "item_id", "width", "total", "telling")
    here = items.withColumnRenamed("place", "at")
    enough = F.least(F.lit(LEAST), F.when(F.col("telling") > 0, F.col("telling")).otherwise(F.col("total")))
    diagonals = (
        hits.join(here, "hash")
        .groupBy("name", *of_item, (F.col("place") - F.col("at")).alias("shift"))
        .agg(F.collect_list(F.struct(F.col("at").alias("place"), "kind", "kinds", "theirs", "ours")).alias("windows"))
        .where(F.size("windows") >= enough)
    )
    judged_ = map_batches(diagonals.drop("shift"), _judge, "name string, item string, item_id long, windows int, share double, exact boolean")
    best = judged_.groupBy("name", "item", "item_id").agg(F.max(F.struct("windows", "exact", "share")).alias("m")).select("name", "item", "item_id", "m.windows", "m.share", "m.exact")
    return ours.where(F.col("hash").isNull()).select("doc_id", "name"), best


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, windows, share, exact: a row for each document and item that occurs in it."""
    found = occurrences(docs, benchmark, block)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, windows int, share double, exact boolean")
    return found[0].join(found[1], "name").select("doc_id", "item_id", "windows", "share", "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item occurs."""
    found = occurrences(docs, benchmark, block)
    if found is None:
        return docs
    # Stored, so that its size is known when it is decided whether to broadcast it.
    names = stored(found[1].select("name").distinct(), "found")
    return docs.join(names, F.md5(F.coalesce(docs["text"], F.lit(""))) == names["name"], "left_anti")
