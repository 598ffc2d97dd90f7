"""Removing repeated passages: every byte covered by a string of LENGTH bytes that also starts earlier, in any document.

Where it may be repeated. Each LENGTH-byte string of a text has an anchor, its K-gram of the least hash (the leftmost of
equals), so equal strings have equal anchors. Starts in a row with one anchor form a piece: n starts and the n + LENGTH - 1
bytes they cover. Pieces are compared by anchor in buckets of anchor hashes. Of equal pieces all but the earliest are
repeated, which a task settles for its own texts before it sends anything. Strings of different pieces can be equal where
the pieces have one anchor: the earliest of each such piece is fetched and goes to a shard of anchors. There, strings fall
into four classes by where the anchor is in them, and what all strings of a class have in common, 83 bytes or more, must be
in another piece too; and of equal runs of strings of a class the earliest goes on, the others are repeated.

What is repeated. A shard joins its pieces and builds one suffix array. Suffixes start out in groups by first symbol;
groups are taken in descending order, each suffix of a group points to the previous suffix of a smaller group, and what is
pointed at is moved, by the number of pointers and its old group, into new groups next to the old ones. In the end a group
holds the suffixes of one longest Lyndon prefix, and one pass over the array in ascending order, which follows the same
pointers, puts every suffix in the next free place of its group. Nothing is renamed or sorted again, and both passes take
time in proportion to the bytes. Strings that are equal are then side by side, and all but the earliest are repeated.

An anchor that very many different pieces share (HOT, after counting in the tasks) would overfill its bucket: its pieces
are dealt string by string instead, each keyed by its own hash, where only equal ones meet. Hashes of 64 bits, in pairs,
stand for pieces and for such strings.

Earlier means a smaller id, or an earlier start in one document. A null id is before all others. Rows of equal id are
ordered by a hash of their texts; rows of equal id and text are one document, with one result each. Ids must be whole
numbers; others raise an error. A null text is an empty one; texts of any length are done whole, in overlapping parts;
other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import id_and_text, map_columns, spread, stored

#: Bytes of a string, and of the grams that anchor it.
LENGTH, K = 100, 32
#: Bytes hashed at a time, and bytes of text whose pieces a task settles together.
PART, CHUNK = 1 << 19, 48 << 20
#: Different pieces of an anchor in one chunk from which it is counted; in all chunks, from which it is dealt by strings.
SEEN, HOT = 16, 20_000
#: Bytes of a shard's suffix array.
SHARD = 1 << 20
NO_ID = -(1 << 63)

_rng = np.random.default_rng(20240229)
_SYMBOL = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if PART not in _POWERS:
        size = PART + 1
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[PART] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[PART]


class Hashed:
    """A run of bytes whose substrings' hashes are differences of sums, shifted to a common place."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * down[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.up[starts])

    def grams(self, k: int) -> np.ndarray:
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k])


def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side in data, each ending before its entry of ends: their hashes, and the first start, number
    of starts, hash of anchor and place of the anchor behind the first start of every piece."""
    none = np.zeros(0, np.int64)
    hashed = Hashed(data)
    if len(data) < LENGTH:
        return hashed, none, none, none.view(np.uint64), none
    grams = hashed.grams(K)
    low = np.uint64((1 << 20) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size, room = 1, LENGTH - K + 1
    while size * 2 <= room:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (room - size)], least[room - size :])
    at = (least & low).astype(np.int64)
    valid = np.ones(len(at), bool)
    for e in ends[:-1]:
        valid[max(0, e - LENGTH + 1) : e] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return hashed, first, stop - first + 1, grams[at[first]], at[first] - first


class Chunk:
    """The pieces of a bounded run of a task's documents."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.docs: list[tuple[int, int]] = []
        self.known: dict[tuple[int, int], int] = {}
        self.bytes = 0
        self.pending: list[tuple[int, int, np.ndarray]] = []
        self.waiting = 0
        self.parts: list[np.ndarray] = []

    def add(self, doc: int, tie: int, text: bytes) -> None:
        if (doc, tie) in self.known:
            return
        self.known[doc, tie] = row = len(self.docs)
        self.docs.append((doc, tie))
        self.bytes += len(text) + 200
        if len(text) < LENGTH:
            return
        data = np.frombuffer(text, np.uint8)
        for at in range(0, len(data) - LENGTH + 1, PART - LENGTH + 1):
            part = data[at : at + PART]
            if self.waiting + len(part) > PART:
                self._hash()
            self.pending.append((row, at, part))
            self.waiting += len(part)

    def _hash(self) -> None:
        if self.pending:
            ends = np.cumsum([len(p) for _, _, p in self.pending])
            hashed, first, n, anchor, at = pieces(np.concatenate([p for _, _, p in self.pending]), ends)
            piece = hashed.of(first, first + n + LENGTH - 1)
            if len(self.hot) and len(first):
                is_hot = self.hot[np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)] == anchor
                if is_hot.any():  # each start is a piece of its own
                    every = np.repeat(first[is_hot], n[is_hot]) + np.concatenate([np.arange(k) for k in n[is_hot]])
                    first, n = np.concatenate([first[~is_hot], every]), np.concatenate([n[~is_hot], np.ones(len(every), np.int64)])
                    at = np.concatenate([at[~is_hot], np.zeros(len(every), np.int64)])
                    anchor, piece = np.concatenate([anchor[~is_hot], hashed.of(every, every + LENGTH)]), np.concatenate([piece[~is_hot], hashed.of(every, every + LENGTH // 2)])
            of = np.searchsorted(ends, first, side="right")
            rows, ats = np.array([r for r, _, _ in self.pending]), np.array([a for _, a, _ in self.pending])
            begin = ends - [len(p) for _, _, p in self.pending]
            out = np.zeros(len(first), RECORD)
            out["anchor"], out["piece"], out["row"], out["start"], out["n"], out["at"] = anchor, piece, rows[of], first - begin[of] + ats[of], n, at
            self.parts.append(out)
        self.pending, self.waiting = [], 0

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """The earliest of all equal pieces, and the rest."""
        self._hash()
        all_ = np.concatenate([np.zeros(0, RECORD), *self.parts])
        rank = np.empty(len(self.docs), np.int64)
        rank[sorted(range(len(self.docs)), key=self.docs.__getitem__)] = np.arange(len(self.docs))
        return earliest(all_, places(all_, rank))[:2]


#: A piece: hashes of anchor and bytes, the number of its document in the chunk, its first start, how many starts, and how
#: far behind the first start the anchor is.
RECORD = np.dtype([("anchor", "<u8"), ("piece", "<u8"), ("row", "<u4"), ("start", "<u8"), ("n", "<u1"), ("at", "<u1")])
#: Starts in a row that are repeated.
SPAN = np.dtype([("row", "<u4"), ("start", "<u8"), ("n", "<u1")])


def places(records: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return rank[records["row"]] << 34 | records["start"].astype(np.int64)


def earliest(records: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the records of equal anchor and piece the one of the least place, in the order of anchors; all others that have
    not its place; and whether the anchor of each of the former has several pieces."""
    order = np.lexsort((records["piece"], records["anchor"]))
    a, p = records["anchor"][order], records["piece"][order]
    same = np.zeros(len(order), bool)
    same[1:] = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
    run = np.flatnonzero(~same)
    sized = np.diff(np.append(run, len(order)))
    inside = np.repeat(sized > 1, sized)
    part = order[inside]
    order[inside] = part[np.lexsort((place[part], np.repeat(run[sized > 1], sized[sized > 1])))]
    lead = place[order[run]][np.cumsum(~same) - 1]
    own = records[order[run]]
    several = np.zeros(len(own), bool)
    equal = own["anchor"][1:] == own["anchor"][:-1]
    several[1:] |= equal
    several[:-1] |= equal
    return own, records[order[same & (place[order] != lead)]], several


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): a whole-number id and what orders rows of equal id."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("long", "integer", "short", "byte"):
        raise TypeError("ids must be whole numbers")
    return id_and_text(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tie"), "text")


def _chunked(hot: Callable[[], np.ndarray], emit: Callable[[Chunk], dict | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(hot())
        for batch in batches:
            for doc, tie, text in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), strict=True):
                chunk.add(doc, tie, text.as_buffer().to_pybytes())
                if chunk.bytes > CHUNK:
                    yield pa.RecordBatch.from_pydict(emit(chunk))
                    chunk = Chunk(hot())
        yield pa.RecordBatch.from_pydict(emit(chunk))

    return run


def _crowded(chunk: Chunk) -> dict:
    """Anchors of SEEN different pieces or more in a chunk, with how many."""
    own, _ = chunk.settled()
    anchors, n = np.unique(own["anchor"], return_counts=True)
    return {"anchor": anchors[n >= SEEN].view(np.int64), "pieces": n[n >= SEEN].astype(np.int64)}


def hot_anchors(texts: DataFrame, hot: int) -> list[int]:
    """Anchors of more than `hot` different pieces, counted in chunks. No more than pieces / hot anchors are hot."""
    counts = texts.mapInArrow(_chunked(lambda: np.zeros(0, np.uint64), _crowded), "anchor long, pieces long")
    found = counts.groupBy("anchor").agg(F.sum("pieces").alias("pieces")).where(F.col("pieces") > hot)
    return [r.anchor for r in found.select("anchor").collect()]


def _to_buckets(buckets: int):
    def emit(chunk: Chunk) -> dict:
        own, rest = chunk.settled()
        out: dict[str, list] = {"bucket": [], "records": [], "rest": [], "docs": []}
        docs = np.array(chunk.docs, np.int64).reshape(-1, 2)
        mine, theirs = own["anchor"] % np.uint64(buckets), rest["anchor"] % np.uint64(buckets)
        own, mine = own[order := np.argsort(mine, kind="stable")], mine[order]
        rest, theirs = rest[order := np.argsort(theirs, kind="stable")], theirs[order]
        for b in np.unique(mine):
            one, two = (x[np.searchsorted(k, b) : np.searchsorted(k, b, side="right")] for x, k in ((own, mine), (rest, theirs)))
            used = np.unique(np.concatenate([one["row"], two["row"]]))
            one, two = one.copy(), two[["row", "start", "n"]].astype(SPAN)
            one["row"], two["row"] = np.searchsorted(used, one["row"]), np.searchsorted(used, two["row"])
            for name, v in zip(out, (int(b), one.tobytes(), two.tobytes(), docs[used].tobytes()), strict=True):
                out[name].append(v)
        return {"bucket": pa.array(out["bucket"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("records", "rest", "docs")}}

    return emit


#: Starts in a row that are repeated, or, with an anchor, a piece to be compared with others of this anchor.
FOUND = "doc long, tie long, start long, n int, anchor long, at int"


def _met(group: pa.Table) -> pa.Table:
    """One bucket: repeated pieces, and the pieces of anchors that several different ones have."""
    records, docs, spans, base = [], [], [], 0
    for one, rest, ids in zip(*(group.column(c).to_pylist() for c in ("records", "rest", "docs")), strict=True):
        a, b, d = np.frombuffer(one, RECORD).copy(), np.frombuffer(rest, SPAN).copy(), np.frombuffer(ids, np.int64).reshape(-1, 2)
        a["row"] += base
        b["row"] += base
        base += len(d)
        records.append(a)
        spans.append(b)
        docs.append(d)
    records, docs, spans = np.concatenate(records), np.concatenate(docs), np.concatenate(spans)
    order = np.lexsort((docs[:, 1], docs[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (docs[order][1:] != docs[order][:-1]).any(axis=1)
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.cumsum(new)  # a document whose row is repeated in several chunks is one
    own, rest, several = earliest(records, places(records, rank))
    ask = own[several]
    row, start, n = (np.concatenate([x[c] for x in (spans, rest, ask)]) for c in ("row", "start", "n"))
    anchor = np.concatenate([np.zeros(len(row) - len(ask), np.int64), ask["anchor"].view(np.int64)])
    out = {"doc": docs[row, 0], "tie": docs[row, 1], "start": start.astype(np.int64), "n": n.astype(np.int32)}
    settled = np.arange(len(row)) < len(row) - len(ask)
    at = np.concatenate([np.zeros(len(row) - len(ask), np.int32), ask["at"].astype(np.int32)])
    return pa.table({**out, "anchor": pa.array(anchor, mask=settled), "at": pa.array(at, mask=settled)})


def suffix_array(text: list[int]) -> list[int]:
    """The start of every suffix in ascending order. text: symbols from 0 on; the last is the only least one."""
    n = len(text)
    counts = [0] * (max(text) + 1)
    for c in text:
        counts[c] += 1
    begin, at = [], 0
    for c in counts:
        begin.append(at)
        at += c
    group = [begin[c] for c in text]  # a group is named by where it starts in the array
    size = [0] * n
    members: list = [None] * n
    for i, g in enumerate(group):
        if size[g]:
            members[g].append(i)
        else:
            members[g] = [i]
        size[g] += 1
    smaller = [-1] * n
    for g in range(n - 1, -1, -1):
        if (inside := members[g]) is None:
            continue
        members[g] = None
        last, times, moved, often = -1, 0, [], False
        for i in inside:
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j == last:
                times += 1
                often = True
            else:
                if last >= 0:
                    moved.append((last, times))
                last, times = j, 1
        if last >= 0:
            moved.append((last, times))
        if len(moved) == 1:
            new = {(-1, group[last]): [last]}
        elif often:
            new = {}
            for j, k in moved:
                new.setdefault((-k, group[j]), []).append(j)
            new = dict(sorted(new.items()))  # those pointed at most often are the largest
        else:
            new = {}
            for j, _ in moved:
                old = group[j]
                if old in new:
                    new[old].append(j)
                else:
                    new[old] = [j]
            new = {(-1, old): js for old, js in new.items()}
        for (_, old), js in new.items():
            rest = size[old] - len(js)
            if rest:
                size[old], g2 = rest, old + rest
                size[g2], members[g2] = len(js), js
                for j in js:
                    group[j] = g2
    out, free, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def repeated_starts(texts: list[bytes], valid: np.ndarray, place: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of the texts side by side, each followed by one byte that is none of theirs: a mask of the valid starts whose
    string of this many bytes also starts at a valid start of a smaller place."""
    data = b"\x00".join(texts) + b"\x00"
    buffer = np.frombuffer(data, np.uint8)
    symbols = buffer.astype(np.int64) + 2
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols[ends] = 1
    symbols[-1] = 0
    order = np.array(suffix_array(symbols.tolist()))
    order = order[valid[order]]
    symbols = np.append(symbols.astype(np.int16), np.zeros(length, np.int16))
    strings = np.lib.stride_tricks.sliding_window_view(symbols, length)
    equal = np.zeros(len(order), bool)
    for at in range(1, len(order), 1 << 14):
        to = min(len(order), at + (1 << 14))
        equal[at:to] = (strings[order[at:to]] == strings[order[at - 1 : to - 1]]).all(axis=1)
    mask = np.zeros(len(buffer), bool)
    if len(order):
        run = np.flatnonzero(~equal)
        least = np.minimum.reduceat(place[order], run)[np.cumsum(~equal) - 1]
        mask[order[place[order] != least]] = True
    return mask


#: A string has LENGTH - K bytes beside its anchor. By how many of them are before it, strings are of four classes; all
#: strings of a class hold the bytes from so far before the anchor's start to so far behind its end.
_SIDE = LENGTH - K
CLASSES = [(k * (_SIDE // 4), _SIDE if k == 3 else (k + 1) * (_SIDE // 4) - 1) for k in range(4)]


def shared_starts(ns: list[int], ats: list[int], texts: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(piece, first, n) in order: starts of one class whose strings may be equal to some of another piece, and starts whose
    strings all are. The pieces come in order of place. The strings of a class and piece are left out if what they have in
    common is in no other piece; of equal runs of strings the earliest is kept, the others are repeated."""
    repeated, kept = [], []
    known: list[dict[bytes, int]] = [{}, {}, {}, {}]
    seen: list[dict[bytes, int]] = [{}, {}, {}, {}]
    for p, (at, n, text) in enumerate(zip(ats, ns, texts, strict=True)):
        for k in (3, 2, 1, 0):  # ascending starts
            low, high = CLASSES[k]
            first, last = max(0, at - high), min(n - 1, at - low)
            if first <= last:
                run = text[first : last + LENGTH]
                if run in known[k]:
                    repeated.append((p, first, last - first + 1))
                else:
                    known[k][run] = p
                    common = text[at - low : at + K + _SIDE - high]
                    seen[k][common] = seen[k].get(common, 0) + 1
                    kept.append((p, first, last - first + 1, k, common))
    return [x[:3] for x in kept if seen[x[3]][x[4]] > 1], repeated


def _compared(group: pa.Table) -> pa.Table:
    """One shard of anchors: the starts at which the pieces repeat strings of other pieces."""
    rows = group.select(["doc", "tie", "start", "n", "at"]).to_pandas()
    texts = group.column("bytes").to_pylist()
    keep = ~rows.duplicated(["doc", "tie", "start"]).to_numpy()
    rows, texts = rows[keep], [t for t, k in zip(texts, keep, strict=True) if k]
    order = np.lexsort((rows.start, rows.tie, rows.doc))
    rows, texts = rows.iloc[order], [texts[k] for k in order]
    parts, repeated = shared_starts(rows.n.to_list(), rows["at"].to_list(), texts)
    spans = np.array(repeated, np.int64).reshape(-1, 3)
    doc, tie, start = (rows[c].to_numpy(np.int64) for c in ("doc", "tie", "start"))
    settled = pa.table({"doc": doc[spans[:, 0]], "tie": tie[spans[:, 0]], "start": start[spans[:, 0]] + spans[:, 1], "n": spans[:, 2].astype(np.int32)})
    if not parts:
        return settled
    of, first, n = (np.array(x) for x in zip(*parts, strict=True))
    texts = [texts[p][a : a + m + LENGTH - 1] for p, a, m in parts]
    rows = rows.iloc[of].assign(n=n, start=start[of] + first)
    n, sizes = rows.n.to_numpy(np.int64), np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(begin, sizes)
    mask = repeated_starts(texts, inside < np.repeat(n, sizes), np.arange(sizes.sum()))  # side by side in order of place
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    first, stop = edge[::2], edge[1::2]
    of = np.searchsorted(begin, first, side="right") - 1
    out = {"doc": rows.doc.to_numpy()[of], "tie": rows.tie.to_numpy()[of], "start": rows.start.to_numpy()[of] + first - begin[of], "n": (stop - first).astype(np.int32)}
    return pa.concat_tables([settled, pa.table(out)])


def _fetched(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("shard", "doc", "tie", "start", "n", "at", "bytes")}
            for doc, tie, text, asked in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), batch.column("text"), batch.column("asked").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in asked:
                    for c, v in zip(out, (x["anchor"] % shards, doc, tie, x["start"], x["n"], x["at"], data[x["start"] : x["start"] + x["n"] + LENGTH - 1]), strict=True):
                        out[c].append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def repeated_spans(docs: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc, tie, start, n): n starts in a row of a document, from start on, at each of which a string of LENGTH bytes
    begins that also starts earlier. doc is NO_ID for a null id; tie is the hash of the text."""
    spark = docs.sparkSession
    texts = _texts(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, 2 * texts.rdd.getNumPartitions())
    dealt = np.sort(np.array(hot_anchors(texts, hot), np.int64).view(np.uint64))
    known = spark.sparkContext.broadcast(dealt)
    records = texts.mapInArrow(_chunked(lambda: known.value, _to_buckets(buckets)), "bucket int, records binary, rest binary, docs binary")
    found = stored(records.groupBy("bucket").applyInArrow(_met, FOUND), "pieces")
    asked = found.where("anchor IS NOT NULL")
    shards = max(partitions, -(-asked.count() * (LENGTH + 36) // shard))
    by_doc = asked.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "anchor", "at")).alias("asked"))
    pieces_ = texts.join(by_doc.hint("shuffle_hash"), ["doc", "tie"]).mapInArrow(_fetched(shards), "shard int, doc long, tie long, start long, n int, at int, bytes binary")
    compared = stored(pieces_.groupBy("shard").applyInArrow(_compared, "doc long, tie long, start long, n int"), "compared")
    return found.where("anchor IS NULL").drop("anchor", "at").union(compared)


def remove_repeats(docs: DataFrame, digest: bool = False, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs: its text as UTF-8 without all bytes that repeated
    strings cover, which may cut a character; with digest, kept_sha256 in place of kept."""
    spans = repeated_spans(docs, hot, shard)
    spans = spread(spans, "doc", "tie").distinct().groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def make():
        def step(ids, texts, found):
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")}
            for id_, text, spans in zip(ids, texts, found, strict=True):
                data = text.encode()
                runs: list[list[int]] = []
                for start, n in sorted((x["start"], x["n"]) for x in spans or ()):
                    end = start + n + LENGTH - 1
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for c, v in zip(out, (id_, len(data), len(data) - len(kept), len(runs), sha256(kept).hexdigest() if digest else kept), strict=True):
                    out[c].append(v)
            return out

        return step

    met = _texts(docs).join(spans.hint("shuffle_hash"), ["doc", "tie"], "left")
    rows = met.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "spans")
    return map_columns(rows, make, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}")
