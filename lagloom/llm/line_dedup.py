"""Removal of repeated lines through a sharded minimal perfect hash.

Every line's key is hashed to 128 bits. Hashes met in at least two documents are counted in Spark and dealt to shards;
each shard becomes a minimal perfect hash (levels of bit arrays with ranks) that numbers its n hashes 0..n-1, and at
each number the arrays hold the other half of the hash as a fingerprint, the count of documents and the last document.
Documents never meet lines in a join: batches of documents send each of their distinct hashes once to its shard, probe
the arrays and get back the hits. So a line in a third of all documents costs one probe a batch.

A null or empty text is one empty line. Rows of one doc_id are one document, and rows without an id are one too, below
all others; where it is the last holder of a line, all its rows keep it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import SPACE, id_and_text, map_columns, stored

#: Hashes of a shard, about: some megabytes of arrays.
SHARD = 200_000
NO_ID = -(2**63)


class PerfectHash:
    """Numbers a set of n distinct 64-bit keys 0..n-1. Each level is a bit array in which the keys that are alone in
    their place set a bit; the others go on to the next level. A key's number is the rank of its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits as bytes of 0 and 1
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            at = cls.place(keys, len(levels), 2 * len(keys))
            alone = np.bincount(at, minlength=2 * len(keys)) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key of the set; -1 or any number for others."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self.place(keys[todo], level, len(bits))
            hit = bits[at] == 1
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> list[bytes]:
        return [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, parts) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(p, np.uint8, offset=8), count=int.from_bytes(p[:8], "little")) for p in parts])


def line_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    """The 128-bit hash of a line's key, in two halves; none if the key is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return divmod(xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace").lower()), 1 << 64)


def hashed_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """Rows of a batch of documents each: (batch, ids, doc_of, h1, h2), a line hash once for each document."""

    def make():
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), iter(range(1 << 31))

        def step(ids, texts):
            doc_of, h = [], []
            for k, t in enumerate(texts):
                found = {line_hash(line, min_chars) for line in t.split("\n")} - {None}
                doc_of += [k] * len(found)
                h += found
            pairs = np.array(h, np.uint64).reshape(-1, 2).view(np.int64)
            return {"batch": [task << 32 | next(count)], "ids": [[NO_ID if i is None else i for i in ids]], "doc_of": [doc_of], "h1": [pairs[:, 0]], "h2": [pairs[:, 1]]}

        return step

    return map_columns(texts, make, "batch long, ids array<long>, doc_of array<int>, h1 array<long>, h2 array<long>")


def _blob(a: np.ndarray, kind) -> bytes:
    return a.astype(kind).tobytes()


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """One shard's hash and arrays. A hash half that two lines share sends the second to the list of spare entries."""
    h1, h2 = group.h1.to_numpy(np.int64), group.h2.to_numpy(np.int64)
    _, first = np.unique(h1, return_index=True)
    spare = np.setdiff1d(np.arange(len(h1)), first)
    keys = h1[first].view(np.uint64)
    mph = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[mph.find(keys)] = first
    order = np.concatenate([order, spare])
    out = {"shard": [int(group.shard.iloc[0])], "levels": [mph.dump()], "n_keys": [len(first)], "fp": [_blob(h2[order], "<i8")]}
    out |= {"n": [_blob(group.n.to_numpy()[order], "<i8")], "last": [_blob(group.last_id.to_numpy()[order], "<i8")], "spare": [_blob(h1[spare], "<i8")]}
    return pd.DataFrame(out, dtype=object)


INDEX = "shard int, levels array<binary>, n_keys long, fp binary, n binary, last binary, spare binary"


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """The index of all line hashes in two documents (ids) or more, a row for each shard."""
    one = lines.select(F.explode(F.arrays_zip("h1", "h2", F.transform("doc_of", lambda k: F.get("ids", k)).alias("id"))).alias("x"))
    one = one.select("x.*").distinct()  # dealt by id too, so that a line of very many documents is added up before it meets
    counted = one.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last_id")).where("n > 1")
    return counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, INDEX)


def _probe(min_docs: int):
    def run(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"batch": [], "h1": [], "h2": [], "last": []}
        if len(index) and len(asked):
            x = index.iloc[0]
            mph, n_keys = PerfectHash.load(list(x.levels)), int(x.n_keys)
            fp, n, last, spare = (np.frombuffer(x[c], "<i8") for c in ("fp", "n", "last", "spare"))
            for batch, a, b in zip(asked.batch, asked.h1, asked.h2, strict=True):
                h1, h2 = np.asarray(a, np.int64), np.asarray(b, np.int64)
                at = mph.find(h1.view(np.uint64))
                hit = (at >= 0) & (fp[at] == h2)
                for k, s in enumerate(spare):  # half a hash in common: next to never
                    same = (h1 == s) & (h2 == fp[n_keys + k])
                    at[same], hit = n_keys + k, hit | same
                hit &= n[at] >= min_docs
                if hit.any():
                    out["batch"].append(batch)
                    out["h1"].append(h1[hit])
                    out["h2"].append(h2[hit])
                    out["last"].append(last[at[hit]])
        return pd.DataFrame(out, dtype=object)

    return run


def _asked(shards: int):
    def make():
        def step(batches, h1, h2):
            out: dict[str, list] = {"shard": [], "batch": [], "h1": [], "h2": []}
            for batch, a, b in zip(batches, h1, h2, strict=True):
                pairs = np.unique(np.stack([np.array(a, np.int64), np.array(b, np.int64)], axis=1), axis=0)
                shard = pairs[:, 0] % shards
                pairs, shard = pairs[order := np.argsort(shard, kind="stable")], shard[order]
                for s, part in zip(np.unique(shard), np.split(pairs, np.flatnonzero(np.diff(shard)) + 1), strict=False):
                    out["shard"].append(int(s))
                    out["batch"].append(batch)
                    out["h1"].append(part[:, 0])
                    out["h2"].append(part[:, 1])
            return out

        return step

    return make


def _losses(lines: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
    """What each document of a batch loses: hashes found in enough documents whose last holder is another."""
    out: dict[str, list] = {"doc_id": [], "h1": [], "h2": []}
    if len(lines) and len(hits):
        x = lines.iloc[0]
        last = {(a, b): c for h1, h2, l in zip(hits.h1, hits.h2, hits["last"], strict=True) for a, b, c in zip(h1, h2, l, strict=True)}
        for k, a, b in zip(x.doc_of, x.h1, x.h2, strict=True):
            keeper = last.get((a, b))
            if keeper is not None and keeper != x.ids[k]:
                out["doc_id"].append(x.ids[k])
                out["h1"].append(a)
                out["h2"].append(b)
    return pd.DataFrame(out, dtype=object)


def lost_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2): line hashes that a document loses; its doc_id is NO_ID where it is null."""
    if min_docs < 2:
        raise ValueError("a line of one document is never a repeated one")
    lines = stored(hashed_lines(id_and_text(docs, id_col, text_col), min_chars), "line-hashes")
    total = lines.agg(F.sum(F.size("h1"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    index = stored(line_index(lines, shards), "line-index")
    asked = map_columns(lines.select("batch", "h1", "h2"), _asked(shards), "shard int, batch long, h1 array<long>, h2 array<long>")
    hits = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe(min_docs), "batch long, h1 array<long>, h2 array<long>, last array<long>")
    return lines.groupBy("batch").cogroup(hits.groupBy("batch")).applyInPandas(_losses, "doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_lines, n_dropped, kept): each row of docs as a struct, its count of lines, of dropped lines, and its
    remaining lines. Documents are told apart by id, so rows that share one are one document, and rows without one are
    too, below all others. A line goes if its key (stripped, A-Z lower-cased) has min_chars code points or more and is in
    min_docs documents or more, except from the largest doc_id that holds it."""
    lost = lost_lines(docs, min_docs, min_chars, id_col, text_col)
    per_doc = lost.distinct().groupBy("doc_id").agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2"))

    @F.pandas_udf("n_lines long, n_dropped long, kept string")
    def cut(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(texts, h1, h2, strict=True):
            lines = t.split("\n")
            kept = lines
            if a is not None:
                gone = set(zip(np.asarray(a).view(np.uint64).tolist(), np.asarray(b).view(np.uint64).tolist(), strict=True))
                kept = [x for x in lines if line_hash(x, min_chars) not in gone]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept"])

    whole = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    joined = whole.join(per_doc, F.col("id") == F.col("doc_id"), "left")
    return joined.select("doc", cut(F.coalesce(F.col(f"doc.{text_col}"), F.lit("")), "h1", "h2").alias("x")).select("doc", "x.n_lines", "x.n_dropped", "x.kept")


def line_report(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    return dedup_lines(docs, min_docs, min_chars).select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
