"""SimHash near duplicates with fuzzy keys from the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The [23, 12] Golay code is perfect: every 23-bit
word is within 3 bits of exactly one codeword. A segment's keys are the indices of the codewords that the segment and
its one-bit neighbours decode to (one or six): two segments that differ in at most 2 bits have a common neighbour and
so a common key. If two fingerprints differ in at most 4 bits, the errors fall on the three segments in one of these
ways, each with its own combined keys of 30 bits or more:
  - two segments equal: both, as they are;
  - one equal, another with 1 or 2 errors: the equal one and a fuzzy key of the other;
  - none equal: one has 1 or 2 errors and the other two exactly one each, so of each of these one half is equal: a
    fuzzy key and two halves.
Equal keys meet in a shuffle, each candidate is verified, and no link is lost.

Near copies of texts are linked by these keys first. Fingerprints of texts that are similar enough may differ in many more
bits, so what is still apart is compared by the prefixes of its sets of word shingles, which lose no pair.

Large groups of near copies do not become all their pairs: every key's members are first verified against one of
them (of texts, the one whose shingles are the most common, which is nearest to the others), components are formed, and only members of one key that are still in different components are compared.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import folded_words, id_and_text, map_columns, most_frequent, scratch, spread, stored
from lagloom.llm.components import components

GENERATOR = 0b110001110101  # of the [23, 12] Golay code
#: Rows (of three numbers) that may be broadcast instead of moving texts.
BROADCAST_ROWS = 1_000_000
#: Shingles (of one number) that may be broadcast instead of moving a set for each pair.
BROADCAST_SHINGLES = 2_000_000
#: Texts, and pairs of sets, that a worker holds as Python lists at once.
TEXTS_AT_ONCE, PAIRS_AT_ONCE = 1_000, 256
#: Bits of a sketch of a set.
SKETCH = 4096
#: A shingle of COMMON texts or more of one in SAMPLE is common; so many of them are held at most. They only order shingles.
SAMPLE, COMMON, COMMON_MOST = 16, 3, 500_000
#: (first bit, width) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(words: list[bytes], k: int, seed: int = 42) -> int:
    """Bit b is set if over half of the hashes of the k-word shingles have it. No words: zero."""
    return majority(shingle_hashes(words, k, seed))


def majority(hashes: list[int]) -> int:
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def shingle_hashes(words: list[bytes], k: int, seed: int = 42) -> list[int]:
    """XXH64 of every k words joined by spaces (of all words if they are fewer)."""
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, seed)] if words else []
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[k:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the words with bits in the low 12 and in the high 11 places, and the error of each remainder."""

    def remainder(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for b in range(22, 10, -1):
            words ^= np.where(words >> b & 1, GENERATOR << (b - 11), 0)
        return words

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    errors = np.array([sum(1 << b for b in e) for n in range(4) for e in combinations(range(23), n)])
    error = np.zeros(1 << 11, np.int64)
    error[remainder(errors)] = errors
    return low, high, error


def decoded(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit word."""
    low, high, error = golay_tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(words: np.ndarray, width: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) pairs: the codeword indices of each word and its one-bit neighbours, each once."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(width))[None, :]], axis=1)
    index = np.sort(decoded(near), axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    rows, _ = np.nonzero(new)
    return rows, index[new]


def four_error_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of 64-bit fingerprints, of which two share one whenever they differ in at most 4 bits."""
    parts = [((fps >> np.uint64(b)) & np.uint64((1 << w) - 1)).astype(np.int64) for b, w in SEGMENTS]
    fuzzy = [fuzzy_keys(p, w) for p, (_, w) in zip(parts, SEGMENTS, strict=True)]
    halves = [((p & ((1 << w // 2) - 1)), (p >> w // 2) | 1 << 12) for p, (_, w) in zip(parts, SEGMENTS, strict=True)]
    every, rows, keys, tag = np.arange(len(fps)), [], [], 0

    def add(row, value):
        nonlocal tag
        rows.append(row)
        keys.append(value | tag << 56)
        tag += 1

    for i, j in combinations(range(3), 2):
        add(every, parts[i] << 23 | parts[j])
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = fuzzy[j]
                add(row, parts[i][row] << 12 | index)
    for i in range(3):
        j, k = [x for x in range(3) if x != i]
        row, index = fuzzy[i]
        for a in halves[j]:
            for b in halves[k]:
                add(row, index << 26 | a[row] << 13 | b[row])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame, fp: str, *carried: str) -> DataFrame:
    """(key, node, carried...) of nodes (node, fp, carried...): the keys of each fingerprint."""

    def make():
        def step(node, fps, *others):
            row, key = four_error_keys(np.array(fps, np.int64).view(np.uint64))
            return {"key": key, "node": np.array(node, np.int64)[row], **{c: np.array(v, np.int64)[row] for c, v in zip(carried, others, strict=True)}}

        return step

    return map_columns(nodes.select("node", fp, *carried), make, ", ".join(f"{c} long" for c in ("key", "node", *carried)))


def shared_rows(rows: DataFrame, held=stored) -> DataFrame:
    """The rows whose key others have too. Only counts of keys are gathered by key; few enough keys are broadcast."""
    keys = held(rows.groupBy("key").count().where("count > 1").select("key"), "keys")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return held(rows.join(keys, "key", "left_semi"), "shared-keys")


def linked(rows: DataFrame, verify, close=None, known: DataFrame | None = None, finish: bool = True) -> DataFrame:
    """Edges (a, b), those known included, that connect what all verified pairs of rows (key, node) of one key connect;
    verify(pairs, held) keeps the pairs (a, b) that count. With close, rows have a spot as well, and a pair is only
    verified if close(spot, spot) holds under one of its keys.

    The members of a key are first compared with one of them, its centre: the one with the least rank if rows have one, or
    else the least node. Pairs of members that are in different components after that are compared if finish is set;
    otherwise they may be missing."""
    spot = ["spot"] if close else []
    near = close or (lambda x, y: F.lit(True))
    pair = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lead = F.struct("rank" if "rank" in rows.columns else F.lit(0).alias("rank"), "node", *spot)
    with scratch(rows.sparkSession) as held:
        shared = shared_rows(rows, held)
        part = components(known) if known is not None else None
        if part is not None:
            shared = shared.join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        else:
            shared = shared.withColumn("part", F.col("node"))
        centres = shared.groupBy("key").agg(F.min(F.struct(lead.alias("lead"), "part")).alias("first")).select("key", "first.*")
        star = shared.join(centres.select("key", "lead", F.col("part").alias("of")), "key").where(F.col("part") != F.col("of"))
        star = star.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), *spot, *[F.col("lead.spot").alias("lead_spot") for _ in spot])
        tried = held(star.where(near("spot", "lead_spot")).select(*pair).distinct(), "star-pairs")
        edges = verify(tried, held)
        if known is not None:
            edges = edges.union(known)
        if not finish:
            return stored(edges, "links")
        edges = held(edges, "star-edges")
        open_ = shared.drop("part").join(components(edges), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"), *spot)
        mixed = open_.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
        open_ = held(open_.join(mixed, "key"), "open-keys")
        x, y = open_.toDF("key", "a", "part_a", *[f"{c}_a" for c in spot]), open_.toDF("key", "b", "part_b", *[f"{c}_b" for c in spot])
        rest = x.join(y, (x.key == y.key) & (x.a > y.b) & (x.part_a != y.part_b) & near("spot_a", "spot_b")).select("a", "b").distinct()
        return stored(edges.union(verify(rest.join(tried, ["a", "b"], "left_anti"), held)), "links")


def overlapping(similarity: float):
    """Whether two sets with a shingle in common can have the similarity, by spots: n << 32 | place of the shingle. Both
    sets have the same order, so if it is the first they share, no more than what follows it is common to both. Under
    the first key of a pair that counts it holds."""

    def close(x: str, y: str) -> Column:
        n = lambda c: F.shiftright(c, 32)
        left = lambda c: n(c) - F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.least(left(x), left(y)) >= similarity / (1 + similarity) * (n(x) + n(y)) - 1e-6

    return close


def within(distance: int):
    """A filter of pairs of nodes that are fingerprints themselves."""
    return lambda pairs, held: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every text, as a signed long. A null or wordless text has zero."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "fp": [signed(fingerprint(folded_words(t), k)) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(id_and_text(docs, id_col, text_col), make, f"doc_id {kind}, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): components of texts whose fingerprints link at 4 or fewer bits, named by
    the least doc_id reached. Rows repeat as they come; a null doc_id takes part and never names a component unless
    it is alone in it (then the name is null). Equal fingerprints are one node, whatever their number."""
    fps = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least_id"))
    parts = components(linked(keyed(spread(nodes.select("node", F.col("node").alias("fp")), "node"), "fp"), within(4)))
    nodes = stored(nodes.join(parts, "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("part")), "parts")
    # a component of one node has its own least id; the others get theirs from a table of components
    named = nodes.groupBy("part").agg(F.count("*").alias("n"), F.min("least_id").alias("component_id")).where("n > 1")
    named = stored(named.select("part", "component_id"), "components")
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    names = nodes.join(named.withColumn("many", F.lit(True)), "part", "left")
    names = stored(names.select(F.col("node").alias("fp"), F.when(F.col("many"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id")), "names")
    return fps.join(names, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, k: int) -> np.ndarray:
    """The hashes of a text's k-word shingles, each once, as signed longs."""
    return np.unique(np.array(shingle_hashes(folded_words(text), k), np.uint64)).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """A bitmap of the shingles modulo SKETCH: what it has and another has not is in the one set alone."""
    bits = np.zeros(SKETCH, np.uint8)
    bits[shingles & (SKETCH - 1)] = 1
    return np.packbits(bits).tobytes()


def common_shingles(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts), by hash: the shingles of COMMON texts or more in a sample of texts (text), COMMON_MOST at most."""

    def make():
        return lambda texts: {"shingle": np.concatenate([shingle_set(t, k) for t in texts])}

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = map_columns(sample, make, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = most_frequent(stored(counts, "common-shingles"), COMMON_MOST).toArrow()
    hashes, n = found["shingle"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def ranked(shingles: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's shingles, rare before common, and the number of rare ones."""
    rank = np.zeros(len(shingles), np.int64)
    if len(hashes):
        place = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        rank = np.where(hashes[place] == shingles, counts[place], 0)
    return shingles[np.lexsort((shingles, rank))], int((rank == 0).sum())


def prefix_length(n: int, similarity: float) -> int:
    """So many of n shingles, in an order that is the same for all sets, that two sets of that Jaccard similarity share
    one of them: such sets have ceil(similarity * n) or more of the n shingles of either in common, which cannot
    all lie behind the first n - ceil(similarity * n) + 1."""
    return n - ceil(similarity * n - 1e-9) + 1


def text_classes(docs: DataFrame, k: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, node, fp, n, rank, keys): a hash of the raw text, one of its words, the fingerprint, number, number
    of rare ones and prefix of its k-word shingles."""
    texts = id_and_text(docs, id_col, text_col)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, k))

    def make():
        hashes, counts = common.value

        def step(ids, raws, texts):
            out = {"doc_id": ids, "raw": raws, "node": [], "fp": [], "n": [], "rank": [], "keys": []}
            for t in texts:
                words = folded_words(t)
                found = shingle_hashes(words, k)
                shingles, rare = ranked(np.unique(np.array(found, np.uint64)).view(np.int64), hashes, counts)
                out["node"].append(signed(xxhash.xxh3_64_intdigest(b" ".join(words))))
                out["fp"].append(signed(majority(found)))
                out["n"].append(len(shingles))
                out["rank"].append(rare)
                out["keys"].append(shingles[: prefix_length(len(shingles), similarity)])
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("doc_id", F.xxhash64("text").alias("raw"), "text")
    return map_columns(rows, make, f"doc_id {kind}, raw long, node long, fp long, n long, rank long, keys array<long>", TEXTS_AT_ONCE)


def similar(texts: DataFrame, named: DataFrame, k: int, similarity: float):
    """A filter of pairs (a, b) of nodes: those with sets of k-word shingles of that Jaccard similarity or more. texts
    (doc_id, raw, text) are read for one document (named: node, raw, one_id) of each node that is in a pair; few enough
    of them are broadcast, so no text moves. Sketches of the sets rule most pairs out before sets meet."""

    def shingles():
        def step(nodes, texts):
            sets = [shingle_set(t, k) for t in texts]
            return {"node": nodes, "n": [len(x) for x in sets], "bits": [sketch(x) for x in sets], "shingles": sets}

        return step

    def possible():
        def step(a, b, m, n, x, y):
            m, n, x, y = np.array(m), np.array(n), *(np.frombuffer(b"".join(z), np.uint8).reshape(len(a), -1) for z in (x, y))
            apart = lambda p, q: np.bitwise_count(p & ~q).sum(1, dtype=np.int64)  # noqa: E731  shingles of one that the other has not, at least
            most = np.minimum(m - apart(x, y), n - apart(y, x))
            keep = np.flatnonzero(most >= similarity * (m + n - most))
            return {"a": np.array(a, np.int64)[keep], "b": np.array(b, np.int64)[keep]}

        return step

    def judged():
        def step(a, b, x, y):
            keep = []
            for p, q in zip(x, y, strict=True):
                common = len(np.intersect1d(np.array(p, np.int64), np.array(q, np.int64), assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            return {"a": a, "b": b, "keep": keep}

        return step

    def verify(pairs: DataFrame, held) -> DataFrame:
        pairs = held(pairs, "candidates")
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = held(named.join(used, "node"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        rows = texts.join(wanted, (texts.raw == wanted.raw) & texts.doc_id.eqNullSafe(wanted.one_id)).select("node", "text")
        sets = held(map_columns(rows, shingles, "node long, n long, bits binary, shingles array<long>", TEXTS_AT_ONCE), "shingles")
        small, sets = sets.select("node", "n", "bits"), sets.select("node", "shingles")
        both = pairs.join(small.toDF("a", "m", "x"), "a").join(small.toDF("b", "n", "y"), "b")
        pairs = held(map_columns(both.select("a", "b", "m", "n", "x", "y"), possible, "a long, b long", 4 * PAIRS_AT_ONCE), "possible")
        if (sets.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= BROADCAST_SHINGLES:
            sets = F.broadcast(sets)
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        return held(map_columns(both.select("a", "b", "x", "y"), judged, "a long, b long, keep boolean", PAIRS_AT_ONCE).where("keep").select("a", "b"), "verified")

    return verify


def without_near_copies(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each group of exact and near copies: the one with the least doc_id.

    Texts with equal words are one node. A pair counts if its sets of k-word shingles have the similarity. Fuzzy keys of the
    fingerprints find the nearest pairs, verified on the shingles; fingerprints of pairs that are similar enough may
    differ in more bits than any key forgives, so whatever is still apart meets by the prefixes of its shingle sets,
    which lose no pair. Texts without words are copies of each other. A null doc_id comes last; of repeated rows (id
    and text) one stays."""
    known = stored(text_classes(docs, k, similarity, id_col, text_col), "text-classes")
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("raw"), "text")
    named = known.groupBy("node").agg(F.min(F.struct("raw", "doc_id")).alias("one")).select("node", "one.raw", F.col("one.doc_id").alias("one_id"))
    named = stored(named, "nodes")
    verify, near, length = similar(texts, named, k, similarity), overlapping(similarity), F.shiftleft("n", 32)
    fuzzy = keyed(spread(known.select("node", "fp", length.alias("spot")).distinct(), "node"), "fp", "spot")
    edges = linked(fuzzy, verify, near, finish=False)
    keys = known.dropDuplicates(["node"]).select("node", "n", "rank", F.posexplode("keys").alias("place", "key"))
    keys = keys.select("key", "node", "rank", length.bitwiseOR(F.col("place").cast("long")).alias("spot"))
    parts = components(linked(keys, verify, near, edges))
    placed = known.join(parts, "node", "left").select("doc_id", "raw", F.coalesce("component", "node").alias("part"))
    best = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.raw").alias("kept_raw"))
    mixed = lambda i, raw: F.xxhash64(i, raw).alias("place")
    kept = kept.select("kept_id", F.col("kept_raw").alias("raw"), mixed("kept_id", "kept_raw"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("raw"))
    rows = rows.select("doc", "raw", mixed(f"doc.{id_col}", "raw"))
    rows = rows.join(kept, (rows.place == kept.place) & (rows.raw == kept.raw) & F.col(f"doc.{id_col}").eqNullSafe(F.col("kept_id")), "left_semi")
    return rows.groupBy("place", "raw").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc.*")
