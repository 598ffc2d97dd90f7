import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lagloom.llm import katz


def brute(docs):
    tokens = {i: (t or "").encode().lower().split() + [katz.END] for i, t in docs}
    train = {i for i in tokens if i is None or zlib.crc32(str(i).encode()) % 10 != 0}
    uni, pairs, hist = Counter(), Counter(), Counter()
    for i in train:
        uni.update(tokens[i])
        pairs.update(zip([katz.BEGIN, *tokens[i]], tokens[i]))
    for (u, _), c in pairs.items():
        hist[u] += c
    n = sum(uni.values())
    classes = lambda c: [float(sum(v == r for v in c.values())) for r in range(1, katz.CUTOFF + 2)]
    cut = lambda d, c: d[c - 1] if c <= katz.CUTOFF else 1 - katz.TAIL
    du, db = katz.discounts(classes(uni)), katz.discounts(classes(pairs))
    p = {w: cut(du, c) * c / n for w, c in uni.items()}
    unknown = 1 - sum(p.values())

    def prob(u, w):
        if c := pairs.get((u, w)):
            return cut(db, c) * c / hist[u]
        if not hist[u]:
            return p.get(w, unknown)
        mine = [(x, c) for (h, x), c in pairs.items() if h == u]
        return (1 - sum(cut(db, c) * c / hist[u] for _, c in mine)) / (1 - sum(p[x] for x, _ in mine)) * p.get(w, unknown)

    for u in list(hist)[:5]:  # every distribution sums to one
        assert sum(prob(u, w) for w in p) + prob(u, b"never seen") == pytest.approx(1)
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in t)
        out[i] = (len(t), sum(w in uni for w in t), n, base, sum(math.log10(prob(u, w)) for u, w in zip([katz.BEGIN, *t], t)))
    return out, train


TEXTS = ["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", "", None, "on the mat the cat sat again", "zebra zebra the", "the the the the the the the cat"] * 5


@pytest.mark.parametrize("known, bucket", [(katz.KNOWN_WORDS, katz.BUCKET), (3, 20)])
def test_scores_equal_brute_force(spark, monkeypatch, known, bucket):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    docs = [(i, f"{t} w{i % 7}" if t and i % 3 else t) for i, t in enumerate(TEXTS)]
    want, train = brute(docs)
    got = katz.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()
    assert len(got) == len(docs)
    for r in got:
        n, k, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, r.doc_id not in train)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


@pytest.mark.parametrize("known, bucket", [(katz.KNOWN_WORDS, katz.BUCKET), (3, 20)])
def test_stored_tables_score_other_texts(spark, monkeypatch, known, bucket):
    monkeypatch.setattr(katz, "BUCKET", bucket)
    docs = [(i, f"{t} w{i % 7}" if t and i % 3 else t) for i, t in enumerate(TEXTS)]
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    new = ["the dog sat on a mat", "unheard words the cat", "", None, "mat mat mat the cat the cat", "THE LOG"]
    model = katz.fit(spark.createDataFrame(docs, "doc_id long, text string"), known)
    same = {r.doc_id: r for r in model.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want, _ = brute(docs)
    assert len(same) == len(docs)
    for i, (n, k, _, base, score) in want.items():
        assert (same[i].n_tokens, same[i].n_known) == (n, k)
        assert same[i].base_score == pytest.approx(base) and same[i].score == pytest.approx(score)
    rows = model.score(spark.createDataFrame([(t,) for t in new * 2], "text string").selectExpr("null AS doc_id", "text")).collect()
    assert len(rows) == 12
    for t in new:  # a held-out document of the same text scores the same
        *_, score = brute([*docs, (held, t)])[0][held]
        assert sum(r.score == pytest.approx(score) for r in rows) >= 2


def test_odd_tables(spark, odd, none):
    rows = katz.score_texts(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert katz.score_texts(none).count() == 0
    model = katz.fit(odd)
    assert model.score(odd).count() == odd.count() and model.score(none).count() == 0
    assert all(r.score == 0.0 for r in katz.fit(none).score(odd).collect())
    only = spark.createDataFrame([(i, "no training here") for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r.train_tokens, r.n_known, r.score) for r in katz.score_texts(only).collect()} == {(0, 0, 0.0)}


def test_numbers_of_documents_do_not_overflow():
    for task in (0, 32_768, 10**6, 33_000_000):
        last = katz.chunk_numbers(task)[-1]
        assert np.int64((last << 16) + 65_535) == (last << 16) + 65_535
        assert katz.chunk_numbers(task + 1)[0] == last + 1


def test_words_that_the_memo_lacks_are_looked_up_together(monkeypatch):
    monkeypatch.setattr(katz, "MEMO", 3)
    words = [b"a", b"b", b"c", b"d", "é".encode(), b"a"]
    place = {h: k for k, h in enumerate(sorted(map(katz.word_hash, words[1:4])))}
    want = [place.get(katz.word_hash(w), -1 - katz.word_hash(w)) for w in words]
    known = katz.Known(np.array(sorted(place)), np.ones(3, np.int64), katz.Unigrams(9, 3, [1] * 6), 1, 1)
    codes, memo = known.coder()
    assert codes(words) == want and codes(words[2:]) == want[2:] and codes([]) == []
    assert memo == dict(zip(words[:3], want[:3], strict=True))
    none = katz.Known(np.empty(0, np.int64), np.empty(0, np.int64), known.uni, 1, 1)
    assert none.coder()[0]([b"a"]) == [-1 - katz.word_hash(b"a")]


def test_words_are_counted_before_they_are_hashed(monkeypatch):
    class Frame:
        def __getattr__(self, name):
            return lambda *columns: self

    made = []
    monkeypatch.setattr(katz, "MEMO", 1)
    monkeypatch.setattr(katz, "map_columns", lambda df, make, schema: made.append(make) or df)
    hashed, whole = [], katz.word_hashes
    monkeypatch.setattr(katz, "word_hashes", lambda words: hashed.append(len(words)) or whole(words))
    katz.unigram_counts(Frame())
    out = made[0]()(["b a B", "", "b b b", "c d e", "a"])
    got = Counter()
    for w, c in zip(out["word"].tolist(), out["c"].tolist(), strict=True):
        got[w] += c
    assert got == {katz.word_hash(w): c for w, c in {b"\n": 5, b"b": 5, b"a": 2, b"c": 1, b"d": 1, b"e": 1}.items()}
    assert len(hashed) > 1 and sum(hashed) == len(out["word"]) < 15
    assert len(made[0]()([])["word"]) == 0
