"""Winnowing fingerprints: rolling k-gram hashes, the least of each window (the rightmost of equals), with positions.

Two texts that share a passage of at least window + k - 1 code points share a selected hash. A text of fewer than k
code points has one hash, of the whole text; one with fewer hashes than a window has the least of them. The empty text
(and null) has no hashes and the empty fingerprint. Repeated texts have equal fingerprints.

The next document of each is found with a range partitioning by id: each range learns the first document of the range
after it, so no task sees more than its own range, and rows move once. Documents of equal id come in the order of
hashes of their texts, so that an id of very many rows is cut into ranges too; null ids come first.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import id_and_text, map_columns

#: Code points of a hashed k-gram, and k-grams of a window: passages of 47 code points are always found.
K, WINDOW = 24, 24
#: Code points hashed at a time; a longer text is done in overlapping pieces.
PIECE = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams of an array of code points (of the whole array if it is shorter). Sums over
    doubling lengths make the hash of k letters from about 2 log2(k) passes."""
    k = min(k, len(points))
    whole, length, size = None, 0, 1
    block = _mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n = len(points) - k + 1
    while True:
        if k & size:
            part = block[length : length + n]
            whole = part if whole is None else whole * _M2 + part
            length += size
        if length == k:
            return (_mixed(whole) >> np.uint64(32)).astype(np.uint32)
        block = block[:-size] * np.uint64(2 * size + 0x5851F42D4C957F2D) + block[size:]
        size *= 2


def selected(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing selects."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    found, step = [], PIECE
    for at in range(0, max(1, len(points) - k - window + 2), step):
        h = gram_hashes(points[at : at + step + k + window - 2], k)
        # least hash first, then the larger position: one 64-bit number orders both
        best = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        w, have = min(window, len(h)), 1
        while have < w:
            more = min(have, w - have)
            best = np.minimum(best[:-more], best[more:])
            have += more
        best = best[np.flatnonzero(np.diff(best, prepend=~best[0]))]
        found.append((at + (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64), (best >> np.uint64(32)).astype(np.uint32)))
    positions = np.concatenate([p for p, _ in found])
    keep = np.diff(positions, prepend=-1) > 0
    return positions[keep], np.concatenate([h for _, h in found])[keep]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, hash): all selected positions, as rows."""

    def make():
        def step(ids, texts):
            out: dict[str, list] = {"doc_id": ids, "positions": [], "hashes": []}
            for t in texts:
                p, h = selected(code_points(t), k, window)
                out["positions"].append(p)
                out["hashes"].append(h.astype(np.int64))
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    packed = map_columns(id_and_text(docs, id_col, text_col), make, f"doc_id {kind}, positions array<long>, hashes array<long>")
    return packed.select("doc_id", F.explode(F.arrays_zip("positions", "hashes")).alias("f")).select("doc_id", F.col("f.positions").alias("position"), F.col("f.hashes").alias("hash"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(key, bounds: list[int]):
    """How many bounds are not above key: found among the first bounds of blocks, then within a block."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    block = F.size(F.filter(F.lit([b[0] for b in blocks]), lambda b: b <= key))
    inner = F.size(F.filter(F.get(F.lit(blocks), block - 1), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * width + inner).cast("int")


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, own, doc_id, text), each part in one partition and in order of ids: the documents of a range of ids,
    then, with own = false, the text of the document after them (after the last: of the first). What the driver
    holds is one id for each range; ranges follow spark.sql.shuffle.partitions. An id that several quantiles fall on
    is cut by hash into as many ranges more."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    texts = id_and_text(docs, id_col, text_col).withColumns({"key": key, "mix": F.xxhash64("text")})
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = Counter(int(b) for b in texts.stat.approxQuantile("key", [r / ranges for r in range(1, ranges)], 0.25 / ranges))
    cuts = [F.lit(x).cast("long") for b, n in found.items() if n > 1 for x in (b, n)]
    ways = F.coalesce(F.create_map(*cuts)[F.col("key")], F.lit(1)) if cuts else F.lit(1)
    part = _range_of(F.col("key"), sorted(found)) * ranges + F.shiftrightunsigned(F.shiftrightunsigned("mix", 40) * ways, 24)
    dealt = texts.withColumn("part", part.cast("int"))
    firsts = sorted((*r.first, r.part) for r in dealt.groupBy("part").agg(F.min(F.struct("part", "key", "mix")).alias("first")).collect())
    before = [(key, mix, firsts[k - 1][0]) for k, (_, key, mix, _) in enumerate(firsts)]
    heads = texts.join(F.broadcast(spark.createDataFrame(before, "key long, mix long, target int")), ["key", "mix"]).groupBy("target").agg(F.min("text").alias("text"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = dealt.select("part", F.lit(True).alias("own"), "key", "mix", "doc_id", "text").unionByName(
        heads.select(F.col("target").alias("part"), F.lit(False).alias("own"), none("long").alias("key"), none("long").alias("mix"), none(docs.schema[id_col].dataType).alias("doc_id"), "text")
    )
    order = ("part", F.desc("own"), "key", F.shiftrightunsigned("mix", 40), "mix", "text")  # parts cut the hashes as unsigned
    return rows.repartition("part").sortWithinPartitions(*order).select("part", "own", "doc_id", "text")


def edit_pairs(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions,
    edited_positions): each text against itself with its last half replaced by the start of the next document. A
    fingerprint is the selected hashes in order of position, eight hexadecimal digits each, with the positions beside
    it; likeness is the Jaccard similarity of the sets of hashes."""
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions")

    def make():
        waiting: list = []  # the document whose successor has yet to come

        def step(parts, own, ids, texts):
            out: dict[str, list] = {c: [] for c in columns}
            for mine, i, t in zip(own, ids, texts, strict=True):
                p, h = selected(code_points(t), k, window)
                if waiting:
                    before_id, before, before_p, before_h = waiting.pop()
                    edited = _edited(before, t)
                    q, e = selected(code_points(edited), k, window)
                    digest = sha256(edited.encode("utf-8", "replace")).hexdigest()
                    row = (before_id, len(before), digest, *(x.astype(">u4").tobytes().hex() for x in (before_h, e)), likeness(before_h, e), likeness(before_h, h), before_p, q)
                    for c, v in zip(columns, row, strict=True):
                        out[c].append(v)
                if mine:
                    waiting.append((i, t, p, h))
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<long>, edited_positions array<long>"
    return map_columns(in_ranges(docs, id_col, text_col), make, schema)
