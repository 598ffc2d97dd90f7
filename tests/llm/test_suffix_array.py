import random
from hashlib import sha256

import numpy as np
import pytest

from lagloom.llm import suffix_array

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length=100):
    """Own reading of the rule, string by string over a dictionary. rows: (id, text); equal rows are one document."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, out = set(), {}
    for known, i, text in docs:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out[known, i, text] = (i if known else None, len(data), len(data) - len(kept), runs, sha256(kept).hexdigest())
    return sorted((out[i is not None, i or 0, t or ""] for i, t in rows), key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def passages(rng, n):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    return [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(n)]


def texts(rng, n):
    """Shared passages whole, cut and edited, between own text; copies; texts that repeat themselves; runs of a letter."""
    shared = passages(rng, 12)
    out = []
    for k in range(n):
        parts = []
        for own in passages(rng, rng.randrange(1, 4)):
            x = rng.choice(shared)
            a, b = sorted(rng.randrange(len(x)) for _ in range(2))
            parts += [own, rng.choice([x, x[a:b], x[:a] + "#" + x[a:], x[a:]])]
        out.append("".join(parts))
    return out + [out[0], out[1], "x" * 150, "x" * 99, "x" * 100, "ab" * 400, shared[0] * 3, "é" * 120]


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(3000):
        x = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(40))] + [0]
        assert suffix_array.suffix_array(x) == sorted(range(len(x)), key=lambda k: x[k:])


def test_repeated_starts_of_a_shard():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 99, 400, dtype=np.uint8).tobytes()
    parts = [base[a : a + n] for a, n in zip(rng.integers(0, 200, 30), rng.integers(20, 150, 30), strict=True)]
    sizes = [len(p) + 1 for p in parts]
    inside = np.concatenate([np.arange(n) for n in sizes])
    valid = inside < np.repeat([n - 10 for n in sizes], sizes)
    mask = suffix_array.repeated_starts(parts, valid, np.arange(sum(sizes)), 10)
    data, seen, want = b"\0".join(parts) + b"\0", set(), []
    for k in range(len(data)):
        want.append(bool(valid[k]) and data[k : k + 10] in seen)
        if valid[k]:
            seen.add(data[k : k + 10])
    assert mask.tolist() == want


@pytest.mark.parametrize("part,chunk,hot,shard", [(1 << 19, 1 << 25, 20_000, 1 << 20), (700, 3000, 3, 2000), (260, 500, 1, 400)])
def test_whole_results_equal_brute_force(spark, monkeypatch, part, chunk, hot, shard):
    """Also with parts, chunks and shards so small that texts are cut, settled and compared apart, and most anchors hot."""
    monkeypatch.setattr(suffix_array, "PART", part)
    monkeypatch.setattr(suffix_array, "CHUNK", chunk)
    monkeypatch.setattr(suffix_array, "SEEN", 1)
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 60)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # Executors import the module afresh: run what they would run here, with these bounds.
    got = local_result(rows, hot) if part != 1 << 19 else rows_of(suffix_array.remove_repeats(df, digest=True))
    assert got == brute(rows)


def local_result(rows, hot):
    """The steps of the operator in this process, task by task, on the functions that tasks run."""
    import pyarrow as pa

    def batches(part):
        yield pa.RecordBatch.from_pydict({"doc": pa.array([r[0] for r in part], pa.int64()), "tie": pa.array([hash(r[1]) for r in part], pa.int64()), "text": pa.array([r[1] for r in part])})

    tasks = [rows[k::5] for k in range(5)]
    counts = {}
    for t in tasks:
        for b in suffix_array._chunked(lambda: np.zeros(0, np.uint64), suffix_array._crowded)(batches(t)):
            for a, n in zip(b.column("anchor").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                counts[a] = counts.get(a, 0) + n
    dealt = np.sort(np.array([a for a, n in counts.items() if n > hot], np.int64).view(np.uint64))
    assert len(dealt)
    sent = pa.Table.from_batches([b for t in tasks for b in suffix_array._chunked(lambda: dealt, suffix_array._to_buckets(7))(batches(t)) if b.num_rows])
    found = pa.concat_tables([suffix_array._met(sent.filter(pa.compute.equal(sent["bucket"], k))) for k in set(sent["bucket"].to_pylist())])
    spans = [(x["doc"], x["start"], x["n"]) for x in found.to_pylist() if x["anchor"] is None]
    by_id = dict(rows)
    asked = [x | {"bytes": by_id[x["doc"]].encode()[x["start"] : x["start"] + x["n"] + 99]} for x in found.to_pylist() if x["anchor"] is not None]
    for k in range(3):
        part = [x for x in asked if x["anchor"] % 3 == k]
        if part:
            spans += [(x["doc"], x["start"], x["n"]) for x in suffix_array._compared(pa.Table.from_pylist(part)).to_pylist()]
    out = []
    for i, t in rows:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for d, s, n in spans:
            if d == i:
                gone[s : s + n + 99] = b"\1" * (n + 99)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), len(data) - len(kept), sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1])), sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(suffix_array.remove_repeats(odd, digest=True)) == brute(rows)
    assert rows_of(suffix_array.remove_repeats(none, digest=True)) == []
    x, y = "one passage of a text " * 9, "another passage of a text, " * 9
    rows = [(1, x), (1, x), (1, y), (1, x + y), (None, y), (None, y), (None, None)]
    got = rows_of(suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True))
    assert len(got) == 7 and got == rows_of(suffix_array.remove_repeats(spark.createDataFrame(rows[::-1], "doc_id long, text string"), digest=True))
    assert [r for r in got if r[0] is None] == [r for r in brute(rows) if r[0] is None]
    kept = suffix_array.remove_repeats(spark.createDataFrame([(1, "é" * 80), (2, "é" * 80)], "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept) for r in kept} == {1: "é".encode(), 2: b""}
    with pytest.raises(TypeError):
        suffix_array.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
