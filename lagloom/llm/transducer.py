"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

All texts are counted once; the most frequent words are encoded and compiled into a minimal acyclic automaton over
UTF-8 bytes (Daciuk's incremental construction from sorted words, states with equal futures shared). Arcs carry
additive outputs, so a walk yields the number of a word, and the word's ids stand at that number. The automaton is
one flat file, shipped with SparkContext.addFile and memory-mapped, so the workers of a machine share its pages.
Words outside it are merged exactly by rank. Decoding joins token strings by one space, as a tokenizer without a
decoder does.

Nulls count as empty texts (no ids, empty decoding). Rows repeat and ids may be null: each row stands on its own.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import struct
import unicodedata
from collections import Counter
from hashlib import sha256
from itertools import chain

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import MEMO, id_and_text, map_columns, most_frequent, shared_file, stored

#: Frequent words that the automaton holds at most; it bounds the file, not what can be encoded.
LEXICON_WORDS = 65_536
#: Texts that a worker holds with their ids at once.
TEXTS_AT_ONCE = 1_000
#: Unicode White_Space, which str.split() exceeds by \x1c-\x1f.
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Marks that often end a piece.
MARKS = frozenset(".,;:!?")
#: Bytes of words and letters of pieces that are long; characters of texts that are settled together.
LONG, TOGETHER = 64, 2_000_000
#: Bits of an id, and what is above all ranks.
ID, NONE = 24, 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of words, as bytes: header, then arrays of first arcs, arc targets, arc outputs,
    id starts and ids (32-bit), final flags and arc labels (8-bit)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # of the word before: final flag and settled arcs of each state on it
    before, order = b"", sorted(words)
    for word in [*order, None]:
        common = 0 if word is None else next((k for k, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
        while len(path) > common + 1:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(final, arcs)))
        if word is not None:
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = True
            before = word
    root = settle(*path[0])
    below = []
    for final, arcs in states:  # targets come first
        below.append(final + sum(below[t] for _, t in arcs))
    first, target, output, label = [0], [], [], bytearray()
    for final, arcs in states:
        n = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            output.append(n)
            n += below[t]
        first.append(len(target))
    starts, ids = [0], []
    for w in order:
        ids += words[w]
        starts.append(len(ids))
    ints = [*first, *target, *output, *starts, *ids]
    head = struct.pack("<5i", len(states), len(target), len(order), len(ids), root)
    return head + struct.pack(f"<{len(ints)}i", *ints) + bytes(int(f) for f, _ in states) + bytes(label)


class Lexicon:
    """A compiled lexicon in a memory-mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, words, ids, self.root = struct.unpack("<5i", self.map[:20])
        sizes = (states + 1, arcs, arcs, words + 1, ids)
        at, parts = 20, []
        for n in sizes:
            parts.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.output, self.starts, self.ids = parts
        self.final, self.labels = at, at + states
        first, flags = np.asarray(self.first), np.frombuffer(self.map, np.uint8)
        # arcs by state and label, in order; none last
        self.arcs = np.append(np.repeat(np.arange(states), np.diff(first)) << 8 | flags[self.labels : self.labels + arcs], np.int64(1) << 60)
        self.accepts, self.targets, self.outputs = flags[at : at + states] > 0, np.asarray(self.target), np.asarray(self.output)

    def find(self, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of words, rows of bytes, all walked a byte at a time; -1 if a word is not in the lexicon."""
        state, n, alive = np.full(len(size), self.root), np.zeros(len(size), np.int64), np.arange(len(size))
        for k in range(letters.shape[1]):
            alive = alive[size[alive] > k]
            key = state[alive] << 8 | letters[alive, k]
            arc = np.searchsorted(self.arcs, key)
            met = self.arcs[arc] == key
            n[alive[~met]] = -1
            alive, arc = alive[met], arc[met]
            n[alive] += self.outputs[arc]
            state[alive] = self.targets[arc]
        return np.where((n >= 0) & self.accepts[state], n, -1)

    def get(self, word: bytes) -> list[int] | None:
        state, n = self.root, 0
        for k in range(len(word)):
            lo, hi = self.first[state] + self.labels, self.first[state + 1] + self.labels
            arc = self.map.find(word[k : k + 1], lo, hi) - self.labels
            if arc < 0:
                return None
            n += self.output[arc]
            state = self.target[arc]
        return self.ids[self.starts[n] : self.starts[n + 1]].tolist() if self.map[self.final + state] else None


class WordBPE:
    """The pieces of a lower-casing byte-level BPE tokenizer file whose words end in a suffix."""

    def __init__(self, spec: dict):
        model, kinds = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE" or model["unk_token"]:
            raise ValueError("this tokenizer file is of another kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: By the ids of two parts: their rank, then the id of what they become.
        self.ranks = {self.vocab[a] << ID | self.vocab[b]: k << ID | self.vocab[a + b] for k, (a, b) in enumerate(pairs)}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.letters = [self.vocab.get(x) for x in byte_letters()]
        self.table = None
        self.last_letters = [self.vocab.get(x + self.suffix) for x in byte_letters()]

    def words(self, chunk: str) -> list[str]:
        """The words of a piece of text without white space, normalised. Letters are one word, also before a mark."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower-cased letter by letter: no final sigma
        chunk = chunk.lower()
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word, by merging the pair of least rank again and again, leftmost first."""
        ids = [self.letters[b] for b in word]
        ids[-1] = self.last_letters[word[-1]]
        get = self.ranks.get
        ranks = [get(a << ID | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < NONE:
            at = ranks.index(rank)
            ids[at : at + 2] = [rank & (1 << ID) - 1]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << ID | ids[at], NONE)
            if at < len(ranks):
                ranks[at] = get(ids[at] << ID | ids[at + 1], NONE)
        return ids

    def merge_all(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words, rows of bytes, at once: their ids in rows, and how many."""
        if self.table is None:
            keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
            order = np.argsort(keys)
            self.table = np.append(keys[order], NONE), np.append(np.fromiter(self.ranks.values(), np.int64, len(keys))[order], NONE)
        keys, ranks_of = self.table

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << ID | b  # below 0 where there is no part
            at = np.searchsorted(keys, key)
            return np.where(keys[at] == key, ranks_of[at], NONE)

        rows, (count, width) = np.arange(len(size)), letters.shape
        place = np.arange(width)
        inner, last = (np.array([-1 if i is None else i for i in x], np.int64) for x in (self.letters, self.last_letters))
        ids = np.where(place < size[:, None], inner[letters], -1)
        ids[rows, size - 1] = last[letters[rows, size - 1]]
        ids = np.concatenate([ids, np.full((count, 1), -1)], axis=1)
        ranks = np.concatenate([rank(ids[:, :-2], ids[:, 1:-1]), np.full((count, 2), NONE)], axis=1)
        done, left = ids.copy(), size.copy()
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            more = best < NONE
            done[rows[~more]] = ids[~more]
            rows, ids, ranks, at, best = rows[more], ids[more], ranks[more], at[more], best[more]
            left[rows] -= 1
            each = np.arange(len(rows))
            # the part behind goes, what is behind it moves up
            source = np.minimum(np.arange(width + 1) + (np.arange(width + 1) > at[:, None]), width)
            ids, ranks = np.take_along_axis(ids, source, axis=1), np.take_along_axis(ranks, source, axis=1)
            ids[each, at] = best & (1 << ID) - 1
            ranks[each, at] = rank(ids[each, at], ids[each, at + 1])
            before = each[at > 0]
            ranks[before, at[before] - 1] = rank(ids[before, at[before] - 1], ids[before, at[before]])
        return done, left


def utf8(word: str) -> bytes:
    return word.encode("utf-8", "replace")


def together(texts: list[str]):
    """Texts in lists of about TOGETHER characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def chunks_of(text: str) -> list[str]:
    """Pieces between Unicode white space."""
    return [c for c in re.split(WHITE, text) if c] if ODD_SPACE.search(text) else text.split()


def frequent_words(docs: DataFrame, spec, top: int) -> DataFrame:
    """(word, n): the most frequent words over all whole texts, counted per batch before they are shuffled."""

    def make():
        bpe = WordBPE(json.loads(spec.value))

        def step(texts):
            rough: Counter[str] = Counter()
            for t in texts:
                rough.update(chunks_of(t))
            words: dict[str, int] = {}
            get = words.get
            for c, n in rough.items():
                for w in bpe.words(c):
                    words[w] = get(w, 0) + n
            return {"word": [utf8(w) for w in words], "n": list(words.values())}

        return step

    counted = map_columns(docs.select("text"), make, "word binary, n long")
    return most_frequent(stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts"), top)


class Encoder:
    """Texts to ids and back, from a compiled lexicon, exact merges and a bounded memo of pieces."""

    def __init__(self, bpe: WordBPE, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.plain: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}
        self.words: dict[str, tuple[int, bytes, bytes]] = {}
        self.shown = {i: (b"%d" % i, t.encode()) for i, t in bpe.strings.items()}

    def ids(self, word: str) -> list[int]:
        raw = utf8(word)
        known = self.lexicon.get(raw)
        return self.bpe.merge(raw) if known is None else known

    def encode(self, text: str) -> list[int]:
        if "<|" in text and self.bpe.specials.search(text):
            out: list[int] = []
            for part in self.bpe.specials.split(text):
                out += [self.bpe.added[part]] if part in self.bpe.added else self.encode(part)
            return out
        chunks = chunks_of(text)
        got = list(map(self.plain.get, chunks))
        if None in got:
            got = [self._plain(c) if g is None else g for c, g in zip(chunks, got, strict=True)]
        return list(chain.from_iterable(got))

    def _plain(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(i for w in self.bpe.words(chunk) for i in self.ids(w))
        if len(chunk) <= LONG and len(self.plain) < MEMO:
            self.plain[chunk] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.bpe.strings[i] for i in ids])

    def rendered(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """Of each text: count of ids, ids as text, decoded text. Pieces seen before come from the memo ready-made; all
        others are settled together. The first pieces and words met, which hold the frequent ones, are remembered."""
        chunks = [None if "<|" in t and self.bpe.specials.search(t) else chunks_of(t) for t in texts]
        got = [c and list(map(self.chunks.get, c)) for c in chunks]
        missed = dict.fromkeys(c for cs, gs in zip(chunks, got, strict=True) if gs and None in gs for c, g in zip(cs, gs, strict=True) if g is None)
        fresh: dict[str, tuple[int, bytes, bytes]] = {}
        if missed:
            words = {c: self.bpe.words(c) for c in missed}
            known = self._coded(list(dict.fromkeys(w for ws in words.values() for w in ws if w not in self.words)))
            for w in known:
                if len(self.words) == MEMO:
                    break
                if len(w) <= LONG:
                    self.words[w] = known[w]
            for c, ws in words.items():
                fresh[c] = self._joined([known[w] if w in known else self.words[w] for w in ws])
                if len(c) <= LONG and len(self.chunks) < MEMO:
                    self.chunks[c] = fresh[c]
        out = []
        for t, cs, gs in zip(texts, chunks, got, strict=True):
            if cs is None:
                out.append(self._render(self.encode(t)))
                continue
            if None in gs:
                gs = [fresh[c] if g is None else g for c, g in zip(cs, gs, strict=True)]
            out.append(self._joined(gs))
        return out

    def _coded(self, words: list[str]) -> dict[str, tuple[int, bytes, bytes]]:
        """Words ready-made: from the lexicon, or merged. Words of about one length are in one table of bytes."""
        done, by_width = {}, {}
        for w in words:
            raw = utf8(w)
            if len(raw) <= LONG:
                by_width.setdefault(-(-len(raw) // 8) * 8, []).append((w, raw))
            else:
                done[w] = self._render(self.ids(w))
        for width, pairs in by_width.items():
            letters = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in pairs]), np.uint8).reshape(-1, width)
            size = np.array([len(raw) for _, raw in pairs])
            number = self.lexicon.find(letters, size)
            for k in np.flatnonzero(number >= 0).tolist():
                n = number[k]
                done[pairs[k][0]] = self._render(self.lexicon.ids[self.lexicon.starts[n] : self.lexicon.starts[n + 1]].tolist())
            rest = np.flatnonzero(number < 0)
            ids, count = self.bpe.merge_all(letters[rest], size[rest])
            for k, i, n in zip(rest.tolist(), ids.tolist(), count.tolist(), strict=True):
                done[pairs[k][0]] = self._render(i[:n])
        return done

    @staticmethod
    def _joined(parts: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        if len(parts) == 1:
            return parts[0]
        counts, numbers, strings = zip(*parts) if parts else ((), (), ())
        if 0 in counts:  # pieces without words
            numbers, strings = ([x for x, n in zip(xs, counts, strict=True) if n] for xs in (numbers, strings))
        return sum(counts), b" ".join(numbers), b" ".join(strings)

    def _render(self, ids) -> tuple[int, bytes, bytes]:
        numbers, strings = zip(*[self.shown[i] for i in ids]) if ids else ((), ())
        return len(ids), b" ".join(numbers), b" ".join(strings)


def build_lexicon(docs: DataFrame, spec: dict, shipped, top: int = LEXICON_WORDS) -> str:
    """Counts words, compiles the frequent ones and gives their file to all executors; returns its name there."""
    bpe = WordBPE(spec)
    rows = frequent_words(docs, shipped, top).collect()  # top bounds them
    lexicon = compile_lexicon({bytes(r.word): bpe.merge(bytes(r.word)) for r in rows})
    path = shared_file(docs.sparkSession, "lexicon", lexicon)
    docs.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, digest: bool = False, top: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded), or with digest the SHA-256 of ids and decoded text in their place."""
    raw = open(tokenizer_path, encoding="utf-8").read()
    texts = id_and_text(docs, id_col, text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(raw)
    name = build_lexicon(texts, json.loads(raw), shipped, top)

    def make():
        coder = Encoder(WordBPE(json.loads(shipped.value)), Lexicon(SparkFiles.get(name)))

        def step(ids, texts):
            if not digest:
                coded = [np.array(coder.encode(t), np.int32) for t in texts]
                return {"doc_id": ids, "n_tokens": [len(c) for c in coded], "ids": coded, "decoded": [coder.decode(c.tolist()) for c in coded]}
            got = [g for some in together(texts) for g in coder.rendered(some)]
            return {"doc_id": ids, "n_tokens": [g[0] for g in got], "ids_sha256": [sha256(g[1]).hexdigest() for g in got], "decoded_sha256": [sha256(g[2]).hexdigest() for g in got]}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    out = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return map_columns(texts, make, f"doc_id {kind}, n_tokens long, {out}", TEXTS_AT_ONCE)
