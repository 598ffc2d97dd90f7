"""Scoring texts with a Katz backoff bigram model.

Tables: unigram counts; bigram counts, in buckets by a hash of the history; backoff weights by history. Counts up to 5
are discounted by Good-Turing estimates, larger ones by a thousandth, so that every history keeps some mass for words
not seen after it. That mass goes to the unigram model in proportion, and the unigram model keeps mass for one unknown
word. All distributions sum to one over the training words, the end and the unknown word:
    p(w | u) = d(c(u,w)) c(u,w) / c(u)      if the pair was seen in training
             = a(u) p(w)                    if the history was; a(u) makes the sum one
             = p(w)                         if it was not
    p(w)     = d(c(w)) c(w) / N, and what is left for an unknown word.

`KatzModel.score` reads the stored tables to score any texts, the query's own documents or others: each distinct pair of
a chunk meets the bigram table, then the backoff weights by history and the unigram table by word. `score_texts` gets the
same figures for the documents it learns beside, whose pairs it need not send a second time.

Scale: a chunk of documents sends its word pairs once, packed in arrays, to the buckets of their histories; a bucket adds
up the training counts and answers each chunk with sums for its documents. The most frequent words (a bounded
number, by whole-corpus counts) are known to all tasks with their counts; whatever else a sum needs is fetched by
joins on hashes. Histories that would overfill a bucket are frequent, hence known, and are spread over several buckets by
the next word; what belongs to a history is then added over its buckets.

A null or empty text is one end. Repeated rows are scored each; with a null doc_id a row counts as training. Without training
text every probability is one. docs must give its rows in the same order whenever it is read (a table does).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import MEMO, folded_words, hand_back, id_and_text, map_columns, most_frequent, stored

#: Counts that Good-Turing discounts, and the share that larger counts give up.
CUTOFF, TAIL = 5, 1e-3
#: Words that all tasks know at most (16 bytes each); pairs of a chunk, of a bucket.
KNOWN_WORDS, CHUNK, BUCKET = 1_000_000, 1_000_000, 800_000
#: No word holds white space, so these stand for the end of a text and for what is before its first word.
END, BEGIN = b"\n", b"\n\n"


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return (np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64) >> np.uint64(1)).astype(np.int64)


def discounts(n: list[float]) -> list[float]:
    """d(1..CUTOFF) from the numbers n of types seen 1..CUTOFF+1 times; where those make no sense, half a count less."""
    cut = (CUTOFF + 1) * n[CUTOFF] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, CUTOFF + 1):
        d = 0.0
        if n[r - 1] and cut < 1:
            d = ((r + 1) * n[r] / n[r - 1] / r - cut) / (1 - cut)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """Totals and discounts of the unigram counts."""

    def __init__(self, n: int, v: int, classes: list[int]):
        self.n, self.v, self.d = n, v, discounts([float(x) for x in classes])
        low = sum(d * (k + 1) * c for k, (d, c) in enumerate(zip(self.d, classes, strict=False)))
        rest = n - sum((k + 1) * c for k, c in enumerate(classes[:CUTOFF]))
        self.unknown = 1 - (low + (1 - TAIL) * rest) / n if n else 1.0

    def log_p(self, c: np.ndarray) -> np.ndarray:
        """log10 p of words with training counts c >= 1."""
        d = np.array([1.0, *self.d, 1 - TAIL])[np.minimum(c, CUTOFF + 1)]
        return np.log10(d * c / max(1, self.n))

    def column(self, c: Column) -> Column:
        """p as a column of training counts; null or 0: the unknown word."""
        d = F.coalesce(*[F.when(c == k + 1, F.lit(x)) for k, x in enumerate(self.d)], F.lit(1 - TAIL))
        return F.when(c > 0, d * c / max(1, self.n)).otherwise(self.unknown)


class Known:
    """The frequent words: hashes in order and counts. A word's code is its place among them, or -1 - hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, uni: Unigrams, buckets: int, least: int):
        self.hashes, self.counts, self.uni, self.buckets = hashes, counts, uni, buckets
        self.least = least  # every word of so many is known

    def coder(self):
        """A function from words to their codes, and a memo of it: words that it lacks are looked up together."""
        memo: dict[bytes, int] = {}

        def codes(words: list[bytes]) -> list[int]:
            h = word_hashes(words)
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found = np.where(self.hashes[at] == h, at, -1 - h).tolist()
            else:
                found = (-1 - h).tolist()
            if len(memo) < MEMO:
                memo.update(zip(words[: MEMO - len(memo)], found, strict=False))
            return found

        return codes, memo

    def hash_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.hashes[np.maximum(codes, 0)] if len(self.hashes) else 0, -1 - codes)

    def bucket_of(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where a pair is counted: by the history, and by the next word too if the history is too large for a bucket."""
        mix = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        c = np.where(u >= 0, self.counts[np.maximum(u, 0)] if len(self.counts) else 0, 0)
        ways = np.maximum(1, 4 * c // BUCKET).astype(np.uint64)
        return ((mix(self.hash_of(u)) + mix(w) % ways) % np.uint64(self.buckets)).astype(np.int64)


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0, F.lit(True))


def unigram_counts(texts: DataFrame) -> DataFrame:
    """(word, c): counts of word hashes, the end among them, over texts (text)."""

    def make():
        def step(texts):
            found: Counter[bytes] = Counter({END: len(texts)})
            words, counts = [], []
            for k, t in enumerate(texts):
                found.update(folded_words(t))
                if len(found) > 2 * MEMO or k == len(texts) - 1:
                    words.append(word_hashes(list(found)))
                    counts.append(np.fromiter(found.values(), np.int64, len(found)))
                    found.clear()
            return {"word": np.concatenate([np.empty(0, np.int64), *words]), "c": np.concatenate([np.empty(0, np.int64), *counts])}

        return step

    return map_columns(texts.select("text"), make, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def known_words(counts: DataFrame, n_docs: int, uni: Unigrams, most: int) -> Known:
    """The most frequent words, at most `most`, and the beginning with its count as a history."""
    rows = most_frequent(counts, most, "c").select("word", "c").toArrow()
    hashes, c = (rows[n].to_numpy().astype(np.int64) for n in ("word", "c"))
    least = int(c.min()) if len(c) else 1 << 62
    hashes, c = np.append(hashes, word_hash(BEGIN)), np.append(c, n_docs)
    order = np.argsort(hashes)
    pairs = max(1, (uni.n + n_docs) * 10 // 9)
    return Known(hashes[order], c[order], uni, max(1, -(-pairs // BUCKET)), least)


def chunk_numbers(task: int) -> range:
    """Numbers of a task's chunks. A chunk has CHUNK tokens and 20,000 documents at most, so 2 ** 22 of them are more than
    any task has, and the number of a document, chunk << 16 and its place, is below 2 ** 63 for 33 million tasks."""
    return range(task << 22, (task + 1) << 22)


REQUEST = (
    "bucket int, chunk long, train binary, n_docs int, u array<long>, run array<int>, w array<int>, rare array<long>, doc array<smallint>, "
    "ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>"
)


def _requests(docs: DataFrame, known) -> DataFrame:
    """The word pairs of chunks of documents, a row for each bucket; and a row for each chunk with what its documents
    need not ask for: token counts, known words and base terms of the frequent words."""

    def make():
        from pyspark import TaskContext

        k: Known = known.value
        find, memo = k.coder()
        begin, end = find([BEGIN, END])
        log_base = np.log10(k.counts + 0.1)
        chunk_id = iter(chunk_numbers(TaskContext.get().partitionId()))

        def pairs_of(text: str) -> np.ndarray:
            words = folded_words(text)
            got = list(map(memo.get, words))
            if None in got:
                missed = [at for at, g in enumerate(got) if g is None]
                for at, c in zip(missed, find([words[at] for at in missed]), strict=True):
                    got[at] = c
            return np.array([begin, *got, end], np.int64)

        def emit(out, ids, train, codes):
            chunk = next(chunk_id)
            u, w = (np.concatenate([c[a : len(c) - 1 + a] for c in codes]) for a in (0, 1))
            n = np.array([len(c) - 1 for c in codes])
            doc = np.repeat(np.arange(len(codes), dtype=np.int16), n)
            seen, log_c = w >= 0, np.zeros(len(w))
            log_c[seen] = log_base[w[seen]]
            row = {"bucket": chunk % k.buckets, "chunk": chunk, "ids": ids, "n_tokens": n, "n_known": np.bincount(doc, seen, len(n)).astype(np.int64), "base": np.bincount(doc, log_c, len(n))}
            for c in out:
                out[c].append(row.get(c))
            bucket = k.bucket_of(u, w)
            order = np.argsort(bucket << 40 ^ k.hash_of(u) & (1 << 40) - 1, kind="stable")
            u, w, doc, bucket = u[order], w[order], doc[order], bucket[order]
            bits = np.packbits(np.array(train, np.uint8)).tobytes()
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, u1, w1, d1 in zip(bucket[np.concatenate([[0], cuts])], *(np.split(x, cuts) for x in (u, w, doc)), strict=True):
                at = np.concatenate([[0], np.flatnonzero(np.diff(u1)) + 1])
                row = {"bucket": int(b), "chunk": chunk, "train": bits, "n_docs": len(ids), "u": u1[at], "run": np.diff(np.append(at, len(u1))).astype(np.int32), "w": np.maximum(w1, -1).astype(np.int32), "rare": w1[w1 < 0], "doc": d1}
                for c in out:
                    out[c].append(row.get(c))

        def step(ids, texts, train):
            out: dict[str, list] = {c.split()[0]: [] for c in REQUEST.split(", ")}
            codes, first = [], 0
            for t in texts:
                codes.append(pairs_of(t))
                if sum(map(len, codes[-1:])) > CHUNK or len(codes) == 20_000 or (len(codes) % 64 == 0 and sum(map(len, codes)) > CHUNK):
                    last = first + len(codes)
                    emit(out, ids[first:last], train[first:last], codes)
                    codes, first = [], last
            if codes:
                emit(out, ids[first:], train[first:], codes)
            return out

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_training(F.col("doc_id")).alias("train"))
    return map_columns(rows, make, REQUEST)


#: What buckets return, packed: k1, k2, k3 and x mean by kind
#:   info: ids, token counts, known words, base terms of a chunk's documents
#:   sums: of those of a chunk's documents that have pairs in the bucket, places (each less the one before) and pairs by
#:     count 1..5 and above (k3), the log terms of seen pairs (x)
#:   bigram: history codes (k1), next codes (each less the one before, k2), run lengths and counts (k3)
#:   history: hashes (k1), their count and that of pairs above the cutoff (k2), pairs seen 1..6 times (k3), p of seen words (x)
#:   rare_next: pairs seen whose next word is not a known one: history, word
#:   unseen: unseen pairs of seen histories: history, document
#:   rare: next words that are not known ones: word, document, whether the pair is unseen
ANSWER = "kind string, bucket int, chunk long, k1 array<long>, k2 array<long>, k3 array<int>, x array<double>"


def _handed_back(run):
    """run, after which what it has freed goes back to the system, so that workers that wait hold little."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        out = run(rows)
        hand_back()
        return out

    return counted


def _count(known):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k: Known = known.value
        out: dict[str, list] = {c.split()[0]: [] for c in ANSWER.split(", ")}
        bucket = int(rows.bucket.iloc[0])

        def add(kind, k1=(), k2=(), k3=(), x=(), chunk=0):
            for c, v in zip(out, (kind, bucket, chunk, k1, k2, k3, x), strict=True):
                out[c].append(v)

        asked = rows.u.notna().to_numpy()
        for r in rows[~asked].itertuples():
            add("info", r.ids, r.n_tokens, np.asarray(r.n_known, np.int32), r.base, int(r.chunk))
        rows = rows[asked]
        if not len(rows):
            return pd.DataFrame(out)
        u = np.repeat(np.concatenate(rows.u.to_list()), np.concatenate(rows.run.to_list()))
        w = np.concatenate(rows.w.to_list()).astype(np.int64)
        w[w < 0] = np.concatenate(rows.rare.to_list())
        n_docs = rows.n_docs.to_numpy(np.int64)
        base = np.concatenate([[0], np.cumsum(n_docs)])
        sizes = [len(d) for d in rows.doc]
        doc = np.concatenate(rows.doc.to_list()).astype(np.int64) + np.repeat(base[:-1], sizes)
        train = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n) for t, n in zip(rows.train, n_docs, strict=True)])
        keys = np.concatenate([(int(c) << 16) + np.arange(n) for c, n in zip(rows.chunk, n_docs, strict=True)])

        order = np.lexsort((w, u))
        u, w, doc = u[order], w[order], doc[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        pair = np.flatnonzero(new)
        c = np.add.reduceat(train[doc].astype(np.int64), pair)  # of each pair
        pu, pw = u[pair], w[pair]
        hist = np.flatnonzero(np.concatenate([[True], pu[1:] != pu[:-1]]))
        h = pu[hist]
        ch = np.where(h >= 0, k.counts[np.maximum(h, 0)], np.add.reduceat(c, hist))  # of each history
        of_pair = np.repeat(np.arange(len(h)), np.diff(np.append(hist, len(pu))))
        log_p = k.uni.log_p(np.maximum(k.counts, 1))

        seen = c > 0
        # model tables
        add("bigram", h, np.diff(pw[seen], prepend=0), np.concatenate([np.add.reduceat(seen.astype(np.int64), hist), np.minimum(c[seen], 2**31 - 1)]).astype(np.int32))
        classes = np.stack([np.add.reduceat((c == r).astype(np.int64), hist) for r in range(1, CUTOFF + 2)], axis=1)
        p = np.where(seen & (pw >= 0), 10.0 ** log_p[np.maximum(pw, 0)], 0.0)
        live = ch > 0
        tail = np.add.reduceat(np.where(c > CUTOFF, c, 0), hist)
        add("history", k.hash_of(h[live]), np.concatenate([ch[live], tail[live]]), classes[live].ravel().astype(np.int32), np.add.reduceat(p, hist)[live])
        odd = seen & (pw < 0)
        add("rare_next", k.hash_of(pu[odd]), -1 - pw[odd])
        # answers
        times = np.diff(np.append(pair, len(u)))
        log_seen = np.where(seen, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(ch[of_pair], 1)), np.where(pw >= 0, log_p[np.maximum(pw, 0)], 0.0))
        total = np.bincount(doc, np.repeat(log_seen, times), base[-1])
        level = np.repeat(np.minimum(c, CUTOFF + 1), times)
        by_level = np.bincount(doc * (CUTOFF + 2) + level, minlength=int(base[-1]) * (CUTOFF + 2)).reshape(-1, CUTOFF + 2)
        here = by_level.any(axis=1)
        for chunk, a, b in zip(rows.chunk, base, base[1:], strict=False):
            places = np.flatnonzero(here[a:b])
            add("sums", k3=np.concatenate([np.diff(places, prepend=0), by_level[a:b][places, 1:].T.ravel()]).astype(np.int32), x=total[a:b][places], chunk=int(chunk))
        missed = np.repeat(~seen & live[of_pair], times)
        add("unseen", np.repeat(k.hash_of(h)[of_pair], times)[missed], keys[doc[missed]])
        rare = w < 0
        add("rare", -1 - w[rare], keys[doc[rare]], np.repeat(~seen, times)[rare].astype(np.int32))
        return pd.DataFrame(out)

    return run


PAIRS = "chunk long, history long, word long, docs array<int>, times array<int>, ids array<long>, n_tokens array<long>"


def _pairs(texts: DataFrame) -> DataFrame:
    """The distinct word pairs of each chunk of documents with the places of the documents that hold them, and a row
    without a history for each chunk: the documents' ids and token counts."""

    def make():
        from pyspark import TaskContext

        begin, end = word_hash(BEGIN), word_hash(END)
        chunk_id = iter(chunk_numbers(TaskContext.get().partitionId()))
        memo: dict[bytes, int] = {}

        def hashed(text: str) -> np.ndarray:
            words = folded_words(text)
            got = list(map(memo.get, words))
            if None in got:
                for k, g in enumerate(got):
                    if g is None:
                        got[k] = word_hash(words[k])
                        if len(memo) < MEMO:
                            memo[words[k]] = got[k]
            return np.array([begin, *got, end], np.int64)

        def emit(out, ids, codes):
            chunk = next(chunk_id)
            u, w = (np.concatenate([c[a : len(c) - 1 + a] for c in codes]) for a in (0, 1))
            n = np.array([len(c) - 1 for c in codes])
            doc = np.repeat(np.arange(len(codes)), n)
            order = np.lexsort((doc, w, u))
            u, w, doc = u[order], w[order], doc[order]
            pair = np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
            held = np.flatnonzero(pair | np.concatenate([[True], doc[1:] != doc[:-1]]))  # a pair in a document
            times, cuts = np.diff(np.append(held, len(u))), np.flatnonzero(pair[held])[1:]
            for k, d, t in zip(np.flatnonzero(pair), np.split(doc[held], cuts), np.split(times, cuts), strict=True):
                for c, v in zip(out, (chunk, u[k], w[k], d, t, None, None), strict=True):
                    out[c].append(v)
            for c, v in zip(out, (chunk, None, None, None, None, ids, n), strict=True):
                out[c].append(v)

        def step(ids, texts):
            out: dict[str, list] = {c.split()[0]: [] for c in PAIRS.split(", ")}
            codes, first, size = [], 0, 0
            for k, t in enumerate(texts):
                codes.append(hashed(t))
                size += len(codes[-1])
                if size > CHUNK or k == len(texts) - 1:
                    emit(out, ids[first : k + 1], codes)
                    codes, first, size = [], k + 1, 0
            return out

        return step

    return map_columns(texts.select(F.col("doc_id").cast("long"), "text"), make, PAIRS)


def _chunk_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk: what its buckets answered, added up."""
    chunk, info = int(rows.chunk.iloc[0]), rows[rows.kind == "info"].iloc[0]
    sums = rows[rows.kind == "sums"]
    n = len(info.k2)
    total, levels = np.zeros(n), np.zeros((n, CUTOFF + 1), np.int64)
    for k3, x in zip(sums.k3, sums.x, strict=True):
        places = np.cumsum(k3[: len(x)])
        total[places] += x
        levels[places] += np.asarray(k3[len(x) :]).reshape(-1, len(x)).T
    out = {"key": (chunk << 16) + np.arange(n), "doc_id": pd.array(list(info.k1), dtype="Int64"), "n_tokens": info.k2, "n_known": info.k3, "base": info.x, "total": total}
    return pd.DataFrame(out | {"levels": list(levels)})


class KatzModel:
    """The stored tables of a fitted model, and the answers for the documents it was fitted beside."""

    def __init__(self, unigrams: DataFrame, answers: DataFrame, uni: Unigrams, known):
        self.unigrams, self.answers, self.uni, self.known = unigrams, answers, uni, known
        self.least_known = known.value.least
        kind = lambda k: answers.where(F.col("kind") == k)
        self.bigrams = kind("bigram").select("bucket", "k1", "k2", "k3")
        pair = lambda k, a, b: kind(k).select(F.explode(F.arrays_zip(F.col("k1").alias(a), F.col("k2").alias(b))).alias("x")).select("x.*")
        n = F.size("k1")
        at = F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
        each = kind("history").where(n > 0).select("k1", "k2", "k3", "x", at)
        cell = lambda c, i: F.get(F.col(c), i)
        i, width = F.col("i"), CUTOFF + 1
        parts = each.select(
            cell("k1", i).alias("history"), cell("k2", i).alias("c"), cell("k2", F.size("k1") + i).alias("tail"), cell("x", i).alias("p_seen"),
            *[cell("k3", i * width + r).alias(f"n{r + 1}") for r in range(width)],
        )
        whole = parts.groupBy("history").agg(F.max("c").alias("c"), *[F.sum(c).alias(c) for c in ("tail", "p_seen", *[f"n{r + 1}" for r in range(width)])])
        whole = stored(whole, "histories")
        self.d = discounts([float(x or 0) for x in whole.agg(*[F.sum(f"n{r + 1}") for r in range(width)]).first()])
        rest = pair("rare_next", "history", "word").join(unigrams, "word", "left").groupBy("history").agg(F.sum(uni.column(F.col("c"))).alias("p_rare"))
        kept = sum((F.col(f"n{r + 1}") * (r + 1) * d for r, d in enumerate(self.d)), F.col("tail") * (1 - TAIL)) / F.col("c")
        whole = whole.join(rest, "history", "left").withColumn("left", 1 - kept)
        #: (history, c, log_weight): log10 of the backoff weight
        self.backoff = whole.select("history", "c", F.log10(F.col("left") / (1 - F.col("p_seen") - F.coalesce("p_rare", F.lit(0.0)))).alias("log_weight"))
        self.backoff = stored(self.backoff, "backoff")
        self.unseen, self.rare = kind("unseen").select("k1", "k2"), kind("rare").select(F.explode(F.arrays_zip("k1", "k2", "k3")).alias("x")).select(F.col("x.k1").alias("word"), F.col("x.k2").alias("key"), F.col("x.k3").alias("unseen"))

    def backed_off(self) -> DataFrame:
        """(key, weights): the sums of the log weights of documents' unseen pairs. Those of known words, as many at most as
        are known, are added up where the pairs are; others meet their weights by history."""
        rows = self.backoff.where((F.col("c") >= self.least_known) | (F.col("history") == word_hash(BEGIN))).select("history", "log_weight").toArrow()
        hashes, weights = rows["history"].to_numpy().astype(np.int64), rows["log_weight"].to_numpy().astype(np.float64)
        order = np.argsort(hashes)
        known = self.unseen.sparkSession.sparkContext.broadcast((hashes[order], weights[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, weights = known.value
            for batch in batches:
                histories, keys = (batch.column(c).flatten().to_numpy() for c in (0, 1))  # as long as each other in each row
                for at in range(0, len(histories), CHUNK // 4):
                    h, key = histories[at : at + CHUNK // 4], keys[at : at + CHUNK // 4]
                    place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                    here = hashes[place] == h if len(hashes) else np.zeros(len(h), bool)
                    one, of = np.unique(key[here], return_inverse=True)
                    rest = int((~here).sum())
                    sums = np.concatenate([np.bincount(of, weights[place[here]], len(one)), np.zeros(rest)])
                    history = pa.array(np.concatenate([np.zeros(len(one), np.int64), h[~here]]), mask=np.arange(len(one) + rest) < len(one))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one, key[~here]])), pa.array(sums), history], ["key", "weights", "history"])

        sums = self.unseen.mapInArrow(run, "key long, weights double, history long")
        rare = sums.where("history IS NOT NULL").join(self.backoff, "history").select("key", F.col("log_weight").alias("weights"))
        return sums.where("history IS NULL").select("key", "weights").union(rare).groupBy("key").agg(F.sum("weights").alias("weights"))

    def bigram_counts(self) -> DataFrame:
        """(history, word, n): the counts of pairs of word hashes, read from the stored table."""
        known = self.known

        def make():
            k: Known = known.value

            def step(histories, words, runs_and_counts):
                u, w, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for h, next_words, rest in zip(histories, words, runs_and_counts, strict=True):
                    u.append(np.repeat(np.array(h, np.int64), rest[: len(h)]))
                    w.append(np.cumsum(np.array(next_words, np.int64)))
                    n.append(np.array(rest[len(h) :], np.int64))
                return {"history": k.hash_of(np.concatenate(u)), "word": k.hash_of(np.concatenate(w)), "n": np.concatenate(n)}

            return step

        return map_columns(self.bigrams.select("k1", "k2", "k3"), make, "history long, word long, n long")

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, n_known, base_score, score) of any texts, from the stored tables: a pair's discounted count if
        it was seen, else its history's backoff weight and the word's own probability. A frequent pair joins with one row of
        each chunk, not one of each occurrence, and a joined partition that is still too large is split by Spark."""
        pairs = stored(_pairs(id_and_text(docs, id_col, text_col)), "pairs")
        met = (
            pairs.where("history IS NOT NULL").select("chunk", "history", "word", "docs", "times")
            .join(self.bigram_counts(), ["history", "word"], "left")
            .join(self.backoff.withColumnRenamed("c", "c_history"), "history", "left")
            .join(self.unigrams, "word", "left")
        )
        d = F.coalesce(*[F.when(F.col("n") == r + 1, F.lit(x)) for r, x in enumerate(self.d)], F.lit(1 - TAIL))
        backed = F.coalesce("log_weight", F.lit(0.0)) + F.log10(self.uni.column(F.col("c")))
        log_p = F.when(F.col("n") > 0, F.log10(d * F.col("n") / F.col("c_history"))).otherwise(backed)
        c = F.coalesce("c", F.lit(0))
        each = met.select("chunk", log_p.alias("log_p"), c.alias("c"), F.log10(c + 0.1).alias("log_c"), F.explode(F.arrays_zip("docs", "times")).alias("x"))
        times = F.col("x.times")
        sums = each.groupBy("chunk", F.col("x.docs").alias("place")).agg(
            F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("n_known"), F.sum(times * F.col("log_c")).alias("base"), F.sum(times * F.col("log_p")).alias("score")
        )
        rows = pairs.where("history IS NULL").select("chunk", F.posexplode(F.arrays_zip("ids", "n_tokens")).alias("place", "x"))
        rows = rows.select("chunk", "place", F.col("x.ids").alias("doc_id"), F.col("x.n_tokens").alias("n_tokens"))
        whole = math.log10(self.uni.n + 0.1 * (self.uni.v + 1))
        return rows.join(sums, ["chunk", "place"]).select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), "score")

    def scores(self) -> DataFrame:
        """(doc_id, n_tokens, n_known, base_score, score) of the documents it was fitted beside."""
        docs = self.answers.where(F.col("kind").isin("info", "sums")).groupBy("chunk").applyInPandas(
            _chunk_sums, "key long, doc_id long, n_tokens long, n_known long, base double, total double, levels array<long>"
        )
        logs = [math.log10(d) for d in (*self.d, 1 - TAIL)]
        seen = F.col("total") + sum(F.get("levels", r) * x for r, x in enumerate(logs))
        backed = self.backed_off()
        c = F.coalesce("c", F.lit(0))
        odd = self.rare.groupBy("word", "key").agg(F.count("*").alias("n"), F.sum("unseen").alias("unseen")).join(self.unigrams, "word", "left").groupBy("key").agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known_rare"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("base_rare"),
            F.sum(F.col("unseen") * F.log10(self.uni.column(F.col("c")))).alias("p_rare"),
        )
        joined = docs.join(backed, "key", "left").join(odd, "key", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        whole = math.log10(self.uni.n + 0.1 * (self.uni.v + 1))
        return joined.select(
            "doc_id", "n_tokens", (F.col("n_known") + zero("known_rare")).cast("long").alias("n_known"),
            (F.col("base") + zero("base_rare") - F.col("n_tokens") * whole).alias("base_score"), (seen + zero("weights") + zero("p_rare")).alias("score"),
        )


def fit(docs: DataFrame, known_most: int = KNOWN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> KatzModel:
    """Counts the training documents' words and pairs, and meets the pairs of all documents with them."""
    texts = id_and_text(docs, id_col, text_col)
    training = texts.where(is_training(F.col("doc_id")))
    unigrams = stored(unigram_counts(training), "unigrams")
    sums = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *[F.coalesce(F.sum((F.col("c") == r).cast("long")), F.lit(0)) for r in range(1, CUTOFF + 2)]).first()
    uni = Unigrams(sums[0], sums[1], list(sums[2:]))
    n_docs = training.count()
    known = docs.sparkSession.sparkContext.broadcast(known_words(unigrams, n_docs, uni, known_most))
    answers = stored(_requests(texts, known).groupBy("bucket").applyInPandas(_handed_back(_count(known)), ANSWER), "answers", "kind")
    return KatzModel(unigrams, answers, uni, known)


def score_texts(docs: DataFrame, known_most: int = KNOWN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    model = fit(docs, known_most, id_col, text_col)
    return model.scores().select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), (~is_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.uni.n).cast("long").alias("train_tokens"), "base_score", "score",
    )
