"""Grouping spelling variants: words one edit apart, each variant led to its frequent form.

Two words that differ by one inserted, deleted or replaced code point share one half of the shorter (or either, when they
are equally long) unchanged, at the start or at the end. So every word is held by its two segments. Shards of segments are
compiled into Aho-Corasick automata; each word is scanned once in every shard that may hold a segment it starts or ends
with, a hit counts only at the offset and for the lengths that one edit allows, and what is left beside the segment must
be one edit apart. That last step looks up the remainders with one code point left out, so that words of one segment
are never compared pair by pair, and verifies the distance.

A segment that very many words share (HOT rows), or one that leaves more than WIDE code points open, is lengthened: the
open part is halved again, and the unchanged half joins the segment. At most one edit is in it, so no pair is lost, and
any hot group comes apart in a few rounds: with one code point open, only the alphabet bounds it. Words have a bounded
number of near words (one edit, an alphabet of 90), so results grow with the words.

Words are counted in each task before they meet. A null or empty text has no words; with a null id no code point is
deleted. Repeated rows count again. Words of any length are held whole. Other columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import id_and_text, scratch, spread, stored

#: Letters of the contract, [A-Za-zÀ-ÿ] in UTF-8, once A-Z are lower-cased.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: Words counted in a task before their counts are sent on.
HELD = 400_000
#: Rows of a shard (a parameter of memory), rows that make a segment hot, open code points that make it too short.
ROWS, HOT, WIDE = 60_000, 20_000, 24


def run_counts(text: bytes, doc_id, every: int | None, min_chars: int) -> Iterator[tuple[bytes | str, int]]:
    """(word, occurrences) of a text in lower case. Of a run whose CRC-32 behind the id is a multiple of `every`, the
    code point at that number modulo its length is deleted."""
    start = None if doc_id is None or not every else crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) < min_chars:
            continue
        if start is not None and (h := crc32(run, start)) % every == 0:
            chars = run.decode()
            at = h % len(chars)
            run = (chars[:at] + chars[at + 1 :]).encode()
        if len(run) - run.count(0xC3) >= min_chars:
            yield run, n


def word_counts(docs: DataFrame, every: int | None, min_chars: int, min_n: int) -> DataFrame:
    """(word, n) of all words of at least min_chars code points and min_n occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in run_counts(text.encode("utf-8", "replace").lower(), doc_id, every, min_chars):
                    counts[word] += n
                if len(counts) > HELD:
                    yield flush()
        if counts:
            yield flush()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def one_edit(a: str, b: str) -> bool:
    """Whether the texts differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the hash of what a word must have unchanged: `held` code points in the length of the word that holds
    the segment, all before `lo` and all from `hi` on."""
    before, after = F.substring("word", F.lit(1), F.col("lo")), F.right("word", F.col("held") - F.col("hi"))
    return rows.withColumn("k", F.xxhash64("held", "lo", "hi", before, after))


def _halves(held, lo, hi):
    mid = F.floor((lo + hi) / 2).cast("int")
    return [F.struct(held.alias("held"), mid.alias("lo"), hi.alias("hi")), F.struct(held.alias("held"), lo.alias("lo"), mid.alias("hi"))]


def segments(words: DataFrame, held, hot: int) -> DataFrame:
    """(word, n, held, lo, hi, k): a row for each segment by which a word is held or may find words held."""
    m = F.char_length("word").cast("int")
    zero = F.lit(0)
    rows = _keyed(words.select("word", "n", F.explode(F.array(*_halves(m, zero, m), *_halves(m - 1, zero, m - 1))).alias("s")).select("word", "n", "s.*"))
    done = None
    while True:
        crowded = rows.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("k", F.lit(True).alias("crowded"))
        width = F.col("hi") - F.col("lo")
        again = (width > 1) & (F.coalesce("crowded", F.lit(False)) | (width > WIDE))
        marked = held(rows.join(crowded, "k", "left").withColumn("again", again).drop("crowded"), "segments")
        done = marked.where("not again") if done is None else done.union(marked.where("not again"))
        more = marked.where("again")
        if more.isEmpty():
            return done.drop("again")
        rows = _keyed(more.select("word", "n", F.explode(F.array(*_halves(F.col("held"), F.col("lo"), F.col("hi")))).alias("s")).select("word", "n", "s.*"))


def _matched(group: pd.DataFrame) -> pd.DataFrame:
    """The near words that one shard finds: an automaton over its segments, through which each of its words goes once."""
    import ahocorasick

    words = dict(zip(group.word, group.n, strict=True))
    keys: dict[tuple, list[str]] = defaultdict(list)
    for word, held, lo, hi in zip(group.word, group.held, group.lo, group.hi, strict=True):
        if len(word) == held:
            keys[held, word[:lo], word[hi:]].append(word)
    trie = ahocorasick.Automaton()
    for _, before, after in keys:
        for segment in (before, after):
            if segment:
                trie.add_word(segment, len(segment))
    out: dict[str, list] = {"word": [], "near": [], "near_n": []}
    if not keys:
        return pd.DataFrame(out, dtype=object)
    trie.make_automaton()
    left_out: dict[tuple, dict] = {}

    def remainders(key: tuple) -> dict:
        """Of the words that hold a segment: their open parts, whole, and with each code point left out."""
        if (found := left_out.get(key)) is None:
            found = left_out[key] = defaultdict(list)
            held, before, after = key
            for word in keys[key]:
                rest = word[len(before) : held - len(after)]
                found[rest].append(word)
                for k in range(len(rest)):
                    found[k, rest[:k] + rest[k + 1 :]].append(word)
        return found

    def met(a: str, b: str) -> None:
        out["word"].append(a)
        out["near"].append(b)
        out["near_n"].append(words[b])

    for word in words:
        m, starts, ends = len(word), [""], [""]
        for at, length in trie.iter(word):
            if at == length - 1:
                starts.append(word[:length])
            if at == m - 1:
                ends.append(word[m - length :])
        for before in starts:
            for after in ends:
                for held in (m, m - 1):
                    if (key := (held, before, after)) in keys:
                        found, rest = remainders(key), word[len(before) : m - len(after)]
                        if held == m:
                            for k in range(len(rest)):
                                for other in found.get((k, rest[:k] + rest[k + 1 :]), ()):
                                    if one_edit(word, other):
                                        met(word, other)
                        else:
                            for shorter in {rest[:k] + rest[k + 1 :] for k in range(len(rest))}:
                                for other in found.get(shorter, ()):
                                    if one_edit(word, other):
                                        met(word, other)
                                        met(other, word)
    return pd.DataFrame(out, dtype=object)


def near_words(words: DataFrame, hot: int = HOT, rows: int = ROWS) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of words (word, n) that are exactly one edit apart, each once."""
    with scratch(words.sparkSession) as held:
        parts = segments(words, held, hot)
        shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // rows))
        found = parts.withColumn("shard", F.pmod("k", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_matched, "word string, near string, near_n long")
        return stored(spread(found, "word").groupBy("word", "near").agg(F.first("near_n").alias("near_n")), "near-words")


def spelling_variants(docs: DataFrame, every: int | None = 31, min_chars: int = 7, min_n: int = 2, times: int = 10, hot: int = HOT, rows: int = ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts. A word's form is its near word of the largest n
    (ties: the smallest), if that n is at least `times` its own, else null; root is the last of the forms that follow
    each other from it, itself if it has none. `every` deletes code points as in run_counts; None deletes none."""
    if times < 2:
        raise ValueError("forms must be more frequent, or they could run in circles")
    words = stored(word_counts(docs, every, min_chars, min_n), "words")
    near = near_words(words, hot, rows).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    ample = -F.col("best.n") >= F.col("n") * times
    led = words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ample, F.col("best.near")).alias("form"), F.when(ample, -F.col("best.n")).alias("form_n")
    )
    led = stored(led, "forms")
    with scratch(docs.sparkSession) as held:
        now = held(led.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:  # each round doubles how far a root is followed; counts grow by `times` a step, so rounds are few
            on = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
            if now.join(on, F.col("root") == F.col("w"), "left_semi").isEmpty():
                break
            now = held(now.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        ends = stored(now.select(F.col("word").alias("w"), "root"), "roots")
    return led.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
