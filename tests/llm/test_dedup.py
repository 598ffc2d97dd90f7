import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import components, line_dedup, queries, simhash


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    mph = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(keys).dump())
    assert sorted(mph.find(keys)) == list(range(len(keys)))


def brute_lines(docs):
    holders = defaultdict(list)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\r\x0b\x0c"))
    for i, t in docs:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders[k].append(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(set(holders[key(x)])) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark, odd, none, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted([tuple(r) for r in line_dedup.line_report(odd).collect()], key=str) == brute_lines(docs)
    assert line_dedup.line_report(none).count() == 0
    monkeypatch.setattr(line_dedup, "SHARD", 2)  # many shards
    assert sorted([tuple(r) for r in line_dedup.line_report(odd).collect()], key=str) == brute_lines(docs)
    again = [(1, "one line of twenty letters\nx"), (1, "one line of twenty letters\ny"), (2, "one line of twenty letters")]
    for rows in (again, [*again, (3, "ONE line of twenty letters ")], [(None, t) for _, t in again] + again):
        got = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted([tuple(r) for r in got], key=str) == brute_lines(rows)
    kept = line_dedup.dedup_lines(odd).select("doc.*")
    assert kept.columns == odd.columns


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 8), (7, 9), (5, 1), (100, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 100: 1, 7: 7, 8: 7, 9: 7}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_four_errors_always_share_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64) * 2 + 1
    e = np.zeros(len(x), np.uint64)
    for _ in range(4):
        e |= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    (r1, k1), (r2, k2) = simhash.four_error_keys(x), simhash.four_error_keys(x ^ e)
    assert {r for r, _ in set(zip(r1, k1, strict=True)) & set(zip(r2, k2, strict=True))} == set(range(len(x)))


def test_golay_decodes_to_the_nearest_codeword():
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    index = simhash.decoded(words)
    flips = words ^ (1 << np.arange(2000) % 23)
    assert index.max() < 4096 and len(np.unique(simhash.decoded(flips))) > 1
    low, high, _ = simhash.golay_tables()
    tops = np.arange(4096) << 11
    codewords = tops | low[tops & 0xFFF] ^ high[tops >> 12]
    assert simhash.decoded(codewords).tolist() == list(range(4096))
    for error in (1, 0b101 << 9, 0b10000000000010000000001):
        assert simhash.decoded(codewords ^ error).tolist() == list(range(4096))


def brute_groups(docs):
    fps = [simhash.fingerprint(simhash.folded_words(t or ""), 4) for _, t in docs]
    part = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                old, new = part[a], part[b]
                part = [new if p == old else p for p in part]
    least = {}
    for (i, _), p in zip(docs, part, strict=True):
        least[p] = min([x for x in (least.get(p), i) if x is not None], default=None)
    return sorted([(i, f"{f:016x}", least[p]) for (i, _), f, p in zip(docs, fps, part, strict=True)], key=str)


def test_groups_equal_brute_force(spark, odd, none, sf_dir):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted([tuple(r) for r in simhash.near_duplicates(odd).collect()], key=str) == brute_groups(docs)
    assert simhash.near_duplicates(none).count() == 0
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, sf_dir).collect()]
    assert sorted([tuple(r) for r in queries.op6_golay_simhash(spark, sf_dir).collect()], key=str) == brute_groups(docs)


def test_fingerprint_is_the_majority():
    import xxhash

    words = b"a b c d e f".split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(words, 4) == want
    assert simhash.fingerprint([], 4) == 0 and simhash.fingerprint(words[:2], 4) == xxhash.xxh64_intdigest(b"a b", 42)


def test_near_copies(spark, odd, none):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    near, far = base[:], base[:]
    near[100] = "changed"
    for k in range(0, 300, 8):
        far[k] = f"other{k}"
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, " ".join(reversed(base))), (6, ""), (7, None), (8, "short one"), (None, " ".join(base))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_copies(frame).collect()) == [1, 3, 5, 6, 8]
    kept = simhash.without_near_copies(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "3", "5", "6", "None"]
    assert simhash.without_near_copies(none).count() == 0


def edited(rng, words, how, share):
    n = max(1, round(share * len(words)))
    new = [f"new{x}" for x in rng.integers(0, 10**9, n)]
    at = int(rng.integers(0, len(words) - n))
    return {
        "appended": words + new, "prepended": new + words, "cut": words[:-n], "inside": words[:at] + new + words[at:],
        "replaced": words[:at] + new + words[at + n :], "scattered": [f"x{k}" if rng.random() < share / 5 else w for k, w in enumerate(words)],
    }[how]


@pytest.mark.parametrize("common", [3, 10**9])
def test_near_copies_equal_brute_force(spark, monkeypatch, common):
    """Every pair of a Jaccard similarity of 0.8 or more, however its words were changed."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "COMMON", common)
    zipf = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 50_000)]
    passage, docs = zipf(40), []
    for how in ("appended", "prepended", "cut", "inside", "replaced", "scattered"):
        for share in (0.05, 0.1, 0.15, 0.2, 0.22, 0.3):
            for _ in range(4):
                words = zipf(int(rng.integers(20, 300))) + passage
                docs += [words, edited(rng, words, how, share)]
    sets = [set(simhash.shingle_hashes(" ".join(w).encode().split(), 5)) for w in docs]
    part, linked = list(range(len(docs))), 0
    for a in range(len(docs)):
        for b in range(a):
            common_ = len(sets[a] & sets[b])
            if common_ >= 0.8 * (len(sets[a]) + len(sets[b]) - common_):
                linked, old, new = linked + 1, part[a], part[b]
                part = [new if p == old else p for p in part]
    assert linked > 60 and len(set(part)) > len(docs) / 2
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_near_copies(frame).collect()) == sorted({part.index(p) for p in part})


@pytest.mark.parametrize("similar", [0.8])
def test_similarity_is_of_five_word_shingles(similar):
    words = [f"w{k}".encode() for k in range(50)]
    assert len(simhash.shingle_hashes(words, 5)) == 46 and len(simhash.shingle_hashes(words[:3], 5)) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(tuple(r) for r in want.fetchall()) == sorted(tuple(r) for r in queries.QUERIES[name](spark, sf_dir).select(*columns).collect())


def test_a_worker_holds_few_sets_at_once(spark, monkeypatch):
    plain = simhash.map_columns

    def watched(df, make, schema, *rows):
        def counted():
            step = make()

            def run(*columns):
                if len(columns[0]) > 1024:
                    raise ValueError(f"{len(columns[0])} rows at once")
                return step(*columns)

            return run

        return plain(df, counted, schema, *rows)

    monkeypatch.setattr(simhash, "map_columns", watched)
    n = 3000
    words = lambda i: " ".join(f"w{(i * 7919 + k) % 100003}" for k in range(12))
    docs = spark.createDataFrame([(i, words(i)) for i in range(n)], "doc_id long, text string").coalesce(1)
    named = docs.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("raw"), F.col("doc_id").alias("one_id"))
    pairs = spark.range(1, n, numPartitions=1).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(spark.range(1).selectExpr("id AS a", "id AS b")).coalesce(1)
    texts = docs.select("doc_id", F.xxhash64("text").alias("raw"), "text")
    with simhash.scratch(spark) as held:
        got = simhash.similar(texts, named, 5, 0.8)(pairs, held).collect()
    assert [(r.a, r.b) for r in got] == [(0, 0)]
