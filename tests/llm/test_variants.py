import random
import re
from collections import Counter
from zlib import crc32

from lagloom.llm import variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def apart_by_one(a, b):
    """Own check of the distance: whether leaving out or replacing one code point of the longer gives the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, min_chars=7, min_n=2, times=10, every=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_n}
    near = {w: [v for v in words if apart_by_one(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: v if words[v] >= times * words[w] else None for w, v in best.items()}

    def last(w):
        return last(form[w]) if form.get(w) else w

    return sorted(((w, form.get(w), last(w), n, len(near[w]), words[form[w]] if form.get(w) else None) for w, n in words.items()), key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(rng, words, copies):
    out = []
    for w in words:
        n = rng.choice(copies)
        out += [w] * n
        for _ in range(rng.choice([0, 1, 3])):
            k, c = rng.randrange(len(w)), rng.choice("abcéÿxyz")
            out += [rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w.upper()])] * rng.choice([1, 2, 3])
    rng.shuffle(out)
    return [(k, " ".join(out[k::40]) + "\n") for k in range(40)]


def test_variants_equal_brute_force(spark, odd, none):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeà") for _ in range(rng.randrange(6, 13))) for _ in range(120)]
    docs = corpus(rng, words, [2, 3, 30, 400])
    # Chains of forms, ties, doubled letters (several edits give one word), and a word shared by all.
    docs += [(100, "aaaaaaa " * 3 + "aaaaaaaa " * 40 + "aaaaaaaaa " * 500 + "aaaaaaab " * 40 + "common-formula " * 9), (101, "Aaaaaaa"), (None, "aaaaaaa ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ ÀÀÀÀÀÀÀ×÷ ÀÀÀÀÀÀÀ×÷"), (102, None), (103, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(variants.spelling_variants(df)) == brute(docs)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(variants.spelling_variants(odd)) == brute(rows)
    assert rows_of(variants.spelling_variants(none)) == []


def test_hot_and_long_segments_lose_no_pair(spark):
    """Hundreds of words that share their first or second half, and words of hundreds of letters, with tiny bounds."""
    rng = random.Random(6)
    tails = ["".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(150)]
    words = [f"sharedh{t}" for t in tails] + [f"{t}sharedtail" for t in tails]
    long = "".join(rng.choice("abc") for _ in range(400))
    words += [long, long[:399], long[:200] + "x" + long[201:], long + "c", "c" + long, long[:100] + long[101:]]
    docs = [(k, " ".join(words)) for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert sum(r[4] for r in want) > 500
    assert rows_of(variants.spelling_variants(df, hot=4, rows=50)) == want
    assert rows_of(variants.spelling_variants(df)) == want


def test_one_edit():
    assert variants.one_edit("abc", "abd") and variants.one_edit("abc", "ac") and variants.one_edit("", "a")
    assert not variants.one_edit("abc", "abc") and not variants.one_edit("abc", "bca") and not variants.one_edit("ab", "abcd")
