from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from lagloom.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(text):
    return sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute(rows):
    by = {}
    own = lambda r, text: h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, own(r, r.text))):
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([own(r, r.text) for r in by[s]]) for s in order}
    top, out = levels([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            leaf = now = own(r, r.text)
            if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
                now = own(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            proof = []
            for tree, j in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run, p = nodes[j // 16 * 16 : j // 16 * 16 + 16], j % 16
                    proof += run[:p] + run[p + 1 :]
                    now, j = h("".join([*run[:p], now, *run[p + 1 :]])), j // 16
            out.append((r.doc_id, leaf, trees[s][-1][0], top[-1][0], h("".join(proof)), now, now == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_manifest_of_odd_rows(odd, none):
    assert rows_of(merkle.manifest(odd, tampered())) == brute(odd.collect())
    assert rows_of(merkle.manifest(none, tampered())) == []


def test_manifest_of_all_shapes(spark):
    """A hot source of 16 ** 2 + 1 leaves, full and broken runs, lone leaves, more than 16 sources, repeated rows, null ids."""
    sizes = {"hot": 257, "full": 16, "over": 17, None: 3, "é": 33, **{f"lone{k}": 1 for k in range(14)}}
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7919 % 1000, f"Text {k % 50} of É", s, "en", None if k % 3 else k))
            k += 1
    rows += rows[:40] + [(None, "same", "hot", None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(7)
    assert rows_of(merkle.manifest(docs, tampered())) == brute(docs.collect())


def test_string_ids_and_no_tampering(spark):
    docs = spark.createDataFrame([(f"id{k}", "s", f"Text {k}") for k in range(40)], "name string, owner string, body string")
    got = merkle.manifest(docs, fields=("name", "owner", "body")).collect()
    assert len(got) == 40 and all(r.verified for r in got) and len({r.proof_sha256 for r in got}) == 40
