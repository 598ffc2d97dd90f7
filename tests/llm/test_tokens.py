import json
import random

import public_tokenizers
import pytest

from lagloom.llm import prefix_counts, transducer
from lagloom.llm.queries import tokenizer

ODD = ["", " ", "  a  b\n\nc\t", "<s> x </s>", "▁▁x ▁", "日本語 と 空白", "a" * 300, " " * 40 + "x", "\0a", "é ½　z", "🤗🤗 ok", "ΑΣ ΟΔΟΣ İstanbul", "it's we're I'LL", "<|startoftext|>Hi <|endoftext|>", "a\x1cb\x85d"]


def texts():
    rng = random.Random(1)
    letters = "ab cde  \n\tE'sétrΣσς12ßİ<|>▁日🤗.,-"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]


@pytest.fixture(scope="module")
def counter():
    return prefix_counts.PrefixCounter(open(tokenizer("piece_bpe_32k.model"), "rb").read())


def test_prefix_counts_equal_the_library_at_every_prefix(counter):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    for t in texts():
        want = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert counter.prefixes(t) == want
        chunks = counter.chunks(t)
        assert sum(counter.ends(chunks)) == want[-1]
        for budget in (1, 4, 9):
            assert counter.fit(chunks, counter.ends(chunks), budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_prefix_tables_answer_without_encoding(spark, odd, none):
    table = prefix_counts.prefix_counts(odd.where("doc_id < 5"), tokenizer("piece_bpe_32k.model"))
    rows = table.select("doc_id", prefix_counts.tokens_of_prefix(table.prefix_tokens, 7).alias("n"), prefix_counts.longest_prefix(table.prefix_tokens, 3).alias("fit")).collect()
    assert {r.doc_id: (r.n, r.fit) for r in rows}[3] == (0, 0) and all(r.n <= 7 for r in rows)
    totals = prefix_counts.token_totals(odd, tokenizer("piece_bpe_32k.model"), 4096)
    got = {r.doc_id: r for r in totals.collect()}
    assert totals.count() == odd.count() and got[4].n_tokens == 0 and got[5].over_limit and got[5].fit_chars < got[5].n_bytes
    assert prefix_counts.token_totals(none, tokenizer("piece_bpe_32k.model"), 4096).count() == 0


def test_lexicon_is_exact_and_minimal(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["a", "tap", "taps", "top", "tops", "été"])}
    blob = transducer.compile_lexicon(words)
    (tmp_path / "lexicon").write_bytes(blob)
    lexicon = transducer.Lexicon(str(tmp_path / "lexicon"))
    assert {w: lexicon.get(w) for w in words} == words
    assert lexicon.get(b"") is None and lexicon.get(b"tapz") is None and lexicon.get(b"to") is None
    states = int.from_bytes(blob[:4], "little")
    assert states < sum(map(len, words))  # suffixes are shared


def test_encoding_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    frame = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: r for r in transducer.encode_documents(frame, path, top=100).collect()}
    digests = {r.doc_id: r for r in transducer.encode_documents(frame, path, top=100, digest=True).collect()}
    from hashlib import sha256

    for i, t in enumerate(texts()):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(got[i].ids) == ids, t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert digests[i].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == sha256(got[i].decoded.encode()).hexdigest()
    assert transducer.encode_documents(odd, path).count() == odd.count()
    assert transducer.encode_documents(none, path).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        transducer.WordBPE(json.load(open(public_tokenizers.path("byte_bpe_50k.json"))))


def test_words_of_a_batch_are_settled_together(tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    bpe = transducer.WordBPE(json.load(open(public_tokenizers.path("word_bpe_49k.json"))))
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    assert all(bpe.pattern.fullmatch(c) for c in letters)  # so that letters are one word
    path = tmp_path / "lexicon"
    path.write_bytes(transducer.compile_lexicon({w: bpe.merge(w) for w in (b"the", b"there", b"!", "straße".encode())}))
    rng = random.Random(5)
    texts = ["The there, theres THEN! x-ray 12.5% Straße? ΣΑΣ é é \x1c .", "", "<|endoftext|>ab <|cd", "don't I'LL 's", "q" * 200 + " " + "é" * 40]
    texts += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz.,'!éßЖ日9", k=rng.randint(1, 30))) for _ in range(50)) for _ in range(40)]
    one = transducer.Encoder(bpe, transducer.Lexicon(str(path)))
    ids = [one.encode(t) for t in texts]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    assert ids == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    many = transducer.Encoder(bpe, transducer.Lexicon(str(path)))
    merge, alone = bpe.merge, []
    monkeypatch.setattr(bpe, "merge", lambda w: alone.append(w) or merge(w))
    monkeypatch.setattr(transducer, "MEMO", 30)
    for _ in range(2):
        assert many.rendered(texts) == [(len(i), " ".join(map(str, i)).encode(), one.decode(i).encode()) for i in ids]
    assert {len(w) > transducer.LONG for w in alone if w not in (b"ab", b"<|", b"cd")} == {True}
