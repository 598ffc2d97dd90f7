"""Benchmark decontamination on templates: numbers, names and units become typed placeholders.

A text is read as chunks between white space. A chunk's token is its lower-cased core without punctuation at its ends,
or a placeholder: NUM for numbers in digits or words, UNIT for a unit or counted noun after a number, NAME for a
capitalised word (also with hyphens, and at the start of a sentence). Names of several words and numbers of several number
words are one placeholder. Windows of tokens are hashed and joined with those of the benchmark. Where a window holds
placeholders, the values in the document and in the item are paired: a re-parameterised copy replaces each value by one
other, everywhere, and no two by the same. An item counts as leaked into a document if enough of its windows are met and enough of the paired
values agree on one replacement, in the document as a whole or in one occurrence: the matches of one alignment (place
in the document less place in the item), or, where words are inserted, of alignments that differ by less than half
the item (bands that overlap by half, so none is cut apart).

Windows with more placeholders than words would meet anything, so they are hashed with their values as they stand. An item's
coverage is the share of its windows that are met, or that of the typed ones alone (of half its windows at least).
Items shorter than a window are one window of their own length. Null and empty texts leak nothing and are leaked
nowhere. Rows are told apart by id and text, on both sides: rows that share an id, or have none, are not mixed, and rows
that are the same are reported once.

The benchmark's windows are known to the tasks as a bitmap of a fixed size, which lets few others pass in one reading
of the documents; what passes meets the windows themselves in a join.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import MEMO, id_and_text, map_columns, stored

#: Tokens of a window, least share of an item's windows, least share of agreeing values, bits of the bitmap.
WINDOW, COVERAGE, AGREEMENT, BITS = 6, 0.4, 0.7, 1 << 26
#: Chunks that are coded at once.
PIECE = 200_000
#: Units of measure and currency.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs ms us ns day days week weeks month months year years "
    "hz khz mhz ghz b kb mb gb tb v kv a ma w kw mw j kj cal kcal pa kpa bar psi k c f % usd eur gbp dollar dollars euro euros cent cents "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet hour hours minute minutes second seconds gram grams kilogram kilograms liter liters litre litres pound pounds".split()
)
#: Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
NUMBER_WORDS = frozenset([*ONES, *TENS, *"hundred thousand million billion dozen".split(), *(f"{t}-{o}" for t in TENS for o in ONES[1:10])])
#: Words of three letters and more that may follow a number and are no counted noun.
NOT_COUNTED = frozenset("and the for are was per but nor from than then with into more less percent".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
CORE = re.compile(r"\w(?:.*\w)?%?", re.S)
_NUM, _NAME, _UNIT = (xxhash.xxh64_intdigest(f"<{x}>") for x in ("num", "name", "unit"))
#: Marks after a word of letters; those that end a sentence.
MARKS, ENDING = frozenset(".,;:!?"), (".", "!", "?", ":")
_M = 0x9E3779B97F4A7C15 | 1
#: What a chunk is: a number, the end of a sentence, a number word, a chunk that ends in its core.
IS_NUMBER, ENDS, IS_WORD_NUMBER, OPEN = 1, 2, 4, 8


def is_name(word: str) -> bool:
    parts = [p for p in re.split("[-'’]", word) if p]
    return len(word) > 1 and bool(parts) and word[0].isupper() and all(p[0].isupper() and (p[1:].islower() or len(p) == 1) or k and p.islower() for k, p in enumerate(parts))


class Tokens:
    """The tokens of some texts, one after another: codes, the codes of the values as they stand, the first chunk of each
    (and where the last ends), and the text of each."""

    def __init__(self, chunks: list[str], codes: np.ndarray, plain: np.ndarray, starts: np.ndarray, text: np.ndarray):
        self.chunks, self.codes, self.plain, self.starts, self.text = chunks, codes, plain, starts, text
        self.slot = (codes == np.uint64(_NUM)) | (codes == np.uint64(_NAME)) | (codes == np.uint64(_UNIT))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, hashes, typed) of the windows of so many tokens."""
        n = len(self.codes) - size + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        count = np.concatenate([[0], np.cumsum(self.slot)])
        typed = 2 * (count[size : size + n] - count[:n]) <= size
        h, exact = np.zeros(n, np.uint64), np.flatnonzero(~typed)
        for k in range(size):
            h = h * np.uint64(_M) + self.codes[k : k + n]
        if len(exact):
            e = np.ones(len(exact), np.uint64)
            for k in range(size):
                e = e * np.uint64(_M) + self.plain[exact + k]
            h[exact] = e
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        good = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return good, h[good].view(np.int64), typed[good]

    def slots(self, at: int, size: int) -> list[str]:
        """The lower-cased values under the placeholders of a window."""
        values = []
        for k in np.flatnonzero(self.slot[at : at + size]) + at:
            chunk = " ".join(self.chunks[self.starts[k] : self.starts[k + 1]])
            values.append((CORE.search(chunk) or [chunk])[0].lower())
        return values


class Reader:
    """Texts as tokens. What a chunk can mean is worked out once: its code, the one after a number, that of its value as
    it stands, and its flags."""

    def __init__(self):
        self.fresh()

    def fresh(self) -> None:
        self.at: dict[str, int] = {}
        self.codes = [array("Q") for _ in range(3)]
        self.flags = array("B")

    def learn(self, chunks: list[str]) -> None:
        """Chunks not met before, each once. Letters alone, also before a mark, are most of them and need no patterns."""
        own, counted, plain, flags = [], [], [], []
        digest = xxhash.xxh64_intdigest
        for chunk in chunks:
            word = chunk if (letters := chunk.isalpha()) else chunk[:-1]
            if letters or chunk[-1] in MARKS and word.isalpha():
                low = word.lower()
                value = digest(low.encode())
                number = spelt = low in NUMBER_WORDS
                name = len(word) > 1 and word[0].isupper() and word[1:].islower()
                flag = OPEN if letters else ENDS if chunk[-1] in ENDING else 0
            else:
                core = CORE.search(chunk)
                word = core[0] if core else chunk
                low = word.lower()
                value = digest(low.encode("utf-8", "replace"))
                spelt = low in NUMBER_WORDS
                number = spelt or bool(NUMBER.fullmatch(word))
                name = is_name(word)
                flag = chunk.endswith(word) * OPEN | chunk.rstrip("\"')»”").endswith(ENDING) * ENDS
            code = _NUM if number else _NAME if name else value
            noun = code == value and (low in UNITS or len(low) > 2 and low.isalpha() and low not in NOT_COUNTED)
            own.append(code)
            counted.append(_UNIT if noun else code)
            plain.append(value)
            flags.append(number * IS_NUMBER | spelt * IS_WORD_NUMBER | flag)
        self.at.update(zip(chunks, range(len(self.flags), len(self.flags) + len(chunks)), strict=True))
        for codes, new in zip(self.codes, (own, counted, plain), strict=True):
            codes.extend(new)
        self.flags.extend(flags)

    def read(self, texts: list[str]) -> Tokens:
        split = [t.split() for t in texts]
        chunks = [c for s in split for c in s]
        if len(self.at) > 2 * MEMO:
            self.fresh()
        got = list(map(self.at.get, chunks))
        if None in got:
            missed = [k for k, g in enumerate(got) if g is None]
            self.learn(list(dict.fromkeys([chunks[k] for k in missed])))
            for k in missed:
                got[k] = self.at[chunks[k]]
        k, text = np.array(got, np.int64), np.repeat(np.arange(len(split)), [len(s) for s in split])
        flags = np.frombuffer(self.flags, np.uint8)[k]
        own, counted, plain = (np.frombuffer(c, np.uint64)[k] for c in self.codes)
        before, joined = np.zeros(len(k), bool), np.zeros(len(k), bool)
        same = text[1:] == text[:-1]
        before[1:] = same & (flags[:-1] & (IS_NUMBER | ENDS) == IS_NUMBER)
        codes = np.where(before, counted, own)
        # what carries on a name or a number in words
        run = (codes[1:] == codes[:-1]) & ((codes[1:] == np.uint64(_NAME)) | (flags[1:] & flags[:-1] & IS_WORD_NUMBER > 0))
        joined[1:] = same & run & (flags[:-1] & (OPEN | ENDS) == OPEN)
        if joined.any():
            keep = np.flatnonzero(~joined)
            folded = plain.copy()
            for p in np.flatnonzero(joined):  # in order, so that a run's code is that of all its words
                folded[p] = (int(folded[p - 1]) * _M + int(plain[p])) & (1 << 64) - 1
            last = np.append(keep[1:], len(k)) - 1
            return Tokens(chunks, codes[keep], folded[last], np.append(keep, len(k)), text[keep])
        return Tokens(chunks, codes, plain, np.arange(len(k) + 1), text)


def pieces(texts: list[str]):
    """(first, last) of runs of texts of about PIECE chunks."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) // 6 + 1
        if size >= PIECE:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, length, at, size, window, typed, slots, n, n_typed): the windows of items, a hash of each item's
    text, and how many tokens, windows and typed windows it has."""
    columns = ("item_id", "item", "length", "at", "size", "window", "typed", "slots", "n", "n_typed")

    def make():
        reader = Reader()

        def step(ids, raws, texts):
            out: dict[str, list] = {c: [] for c in columns}
            for i, raw, t in zip(ids, raws, texts, strict=True):
                tokens = reader.read([t])
                length = len(tokens.codes)
                w = min(size, length)
                at, h, typed = tokens.windows(w) if w else ((), (), np.zeros(0, bool))
                for p, x, y in zip(at, h, typed, strict=True):
                    for c, v in zip(columns, (i, raw, length, int(p), w, int(x), bool(y), tokens.slots(int(p), w), len(h), int(typed.sum())), strict=True):
                        out[c].append(v)
            return out

        return step

    kind = items.schema[id_col].dataType.simpleString()
    texts = id_and_text(items, id_col, text_col).select("doc_id", F.xxhash64("text").alias("item"), "text").distinct()
    return map_columns(texts, make, f"item_id {kind}, item long, length int, at int, size int, window long, typed boolean, slots array<string>, n int, n_typed int")


def bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """A bit for every window modulo so many, as bytes."""
    place = (F.pmod("window", F.lit(bits)) + 1).alias("place")
    parts = index.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bytes"))
    table = np.zeros(bits // 8, np.uint8)
    for bucket, part in parts.collect():  # bits / 32768 rows of 4 KB at most
        part = np.frombuffer(bytes(part), np.uint8)
        at = (bucket - 1) * 4096
        table[at : at + 4096] = part[: len(table) - at]
    return table


def _met(docs: DataFrame, kind: str, sizes: list[int], wanted) -> DataFrame:
    """(doc_id, raw, window, size, doc_at, doc_slots): the windows of documents that may be among the wanted ones."""
    columns = ("doc_id", "raw", "window", "size", "doc_at", "doc_slots")

    def make():
        reader, table = Reader(), wanted.value

        def step(ids, raws, texts):
            out: dict[str, list] = {c: [] for c in columns}
            for first, last in pieces(texts):
                tokens = reader.read(texts[first:last])
                begin = np.searchsorted(tokens.text, np.arange(last - first))
                for size in sizes:
                    at, h, _ = tokens.windows(size)
                    place = h % (8 * len(table))
                    for k in np.flatnonzero(table[place >> 3] >> (place & 7).astype(np.uint8) & 1):
                        p = int(at[k])
                        d = int(tokens.text[p])
                        for c, v in zip(columns, (ids[first + d], raws[first + d], int(h[k]), size, p - int(begin[d]), tokens.slots(p, size)), strict=True):
                            out[c].append(v)
            return out

        return step

    return map_columns(docs, make, f"doc_id {kind}, raw long, window long, size int, doc_at int, doc_slots array<string>")


def _leaks(
    docs: DataFrame, items: DataFrame, size: int = WINDOW, coverage: float = COVERAGE, agreement: float = AGREEMENT, bits: int = BITS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """leaks() with raw and item, the hashes of both texts."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    index = stored(item_windows(items, size, item_id, item_text), "item-windows")
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())  # at most `size` numbers
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("raw"), "text")
    met = _met(texts, kind, sizes, spark.sparkContext.broadcast(bitmap(index, bits)))
    known = index.select("window", "size").distinct()
    met = stored(met.join(known, ["window", "size"], "left_semi").distinct(), "met-windows")
    apart = met.join(index, ["window", "size"])
    shift, half = F.col("doc_at") - F.col("at"), F.greatest(F.floor(F.col("length") / 2), F.lit(1))
    band = F.floor(shift / half)
    spot = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    apart = apart.withColumn("spot", F.explode(F.array(spot(1, shift), spot(2, band), spot(2, band - 1))))
    whole = met.drop("doc_at").distinct().join(index, ["window", "size"]).withColumn("spot", spot(0, F.lit(0)))
    of = ["doc_id", "raw", "item_id", "item", "spot", "n", "n_typed"]
    pairs = apart.select(*(columns := [*of, "at", "typed", "slots", "doc_slots"])).union(whole.select(*columns))
    # of each item value, the document's value that stands for it most often; one that stands for two values agrees with neither
    pairs = pairs.select(*of, F.struct("at", "typed").alias("at"), F.explode_outer(F.arrays_zip("slots", "doc_slots")).alias("slot"))
    each = pairs.groupBy(*of, F.col("slot.slots").alias("value"), F.col("slot.doc_slots").alias("stands")).agg(F.count("slot").alias("times"), F.collect_set("at").alias("ats"))
    value = each.groupBy(*of, "value").agg(F.sum("times").alias("times"), F.max(F.struct("times", "stands")).alias("best"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    found = value.groupBy(*of).agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.sum("times").alias("times"), F.array_sort(F.collect_list(F.struct("best.stands", "best.times"))).alias("bests")
    )
    beside = lambda x, i: F.coalesce(F.get("bests", i)["stands"] == x["stands"], F.lit(False))
    agreed = F.aggregate(F.transform("bests", lambda x, i: F.when(beside(x, i - 1) | beside(x, i + 1), 0).otherwise(x["times"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    found = found.withColumn("agreement", F.coalesce(F.try_divide(agreed, F.col("times")), F.lit(1.0)))
    n_met, n_typed = F.size("ats").cast("long"), F.size(F.filter("ats", lambda x: x["typed"]))
    share = F.greatest(n_met / F.col("n"), n_typed / F.greatest(F.col("n_typed"), F.col("n") / 2))
    found = found.select("doc_id", "raw", "item_id", "item", "spot", F.col("n").cast("long").alias("n_windows"), n_met.alias("n_met"), share.alias("coverage"), "agreement")
    found = found.where((F.col("coverage") >= coverage) & (F.col("agreement") >= agreement))
    # the document's own figures if it passes as a whole, or else those of its fullest occurrence
    best = F.max(F.struct((F.col("spot.kind") == 0).alias("whole"), "coverage", "agreement", "n_met")).alias("best")
    found = found.groupBy("doc_id", "raw", "item_id", "item", "n_windows").agg(best)
    return found.select("doc_id", "raw", "item_id", "item", "n_windows", "best.n_met", "best.coverage", "best.agreement")


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_windows, n_met, coverage, agreement): the documents that hold an item, with their items; how:
    what _leaks() takes."""
    return _leaks(docs, items, **how).drop("raw", "item")


def without_leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs into which no item has leaked."""
    held = _leaks(docs, items, **how).select(F.col("doc_id").alias("leaked"), "raw").distinct()
    ids, text = docs[how.get("id_col", "doc_id")], F.coalesce(docs[how.get("text_col", "text")], F.lit(""))
    return docs.join(held, (F.xxhash64(text) == held.raw) & ids.eqNullSafe(held.leaked), "left_anti")
