"""Token counts at every prefix of a text, by dynamic programming over BPE tokens.

A byte-pair encoding is local: the tokens of a prefix are those of a shorter prefix and one last token. So position i
needs only the length of its last token: the one token that ends there and stands beside the last token of the
position where it starts (the pair encodes to itself). The count follows by adding one to the count there. With the
counts of all prefixes stored, how many tokens a truncated text has, and how much of a text fits a budget, are look-ups.

Nulls count as empty texts (no tokens). Rows repeat, ids may be null or repeat: each row is answered on its own.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import MEMO, id_and_text, map_columns

MARK = "▁"  # stands for a space
SHORT = (2, 1)


class PrefixCounter:
    """Prefix counts for a sentence-piece BPE model with byte fallback, a dummy prefix and no normalisation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with the identity normaliser and a dummy prefix are supported")
        if any(p.type == 4 for p in proto.pieces) or not proto.trainer_spec.byte_fallback:
            raise ValueError("user-defined pieces and models without byte fallback are not supported")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece joins words")
        sizes: dict[str, set[int]] = {}  # of the pieces that end in three letters
        for p in self.score:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        self.beside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.ending = {end: (*sorted(found, reverse=True), *SHORT) for end, found in sizes.items()}
        self.newline_alone = not any("\n" in p for p in self.score)
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.known: dict[str, tuple[tuple[int, ...], tuple[str | None, ...]]] = {}
        self.total: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging the best pair again and again, leftmost first."""
        parts, get = list(text), self.score.get
        scores = [get(a + b) for a, b in zip(parts, parts[1:])]
        while found := [s for s in scores if s is not None]:
            at = scores.index(max(found))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores[at : at + 1] = []
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1])
        return parts

    def fits(self, before: str | None, token: str) -> bool:
        """Whether the token may follow: the two alone encode to themselves."""
        if len(self.pairs) > 4 * MEMO:
            self.pairs.clear()
        ok = self.merged(token) == [token] if before is None else self.merged(before + token) == [before, token]
        self.pairs[before, token] = ok
        return ok

    def chunk(self, chunk: str) -> list[int]:
        """Counts at the prefixes 0..len(chunk) of a piece of text that no token leaves."""
        return self.states(chunk)[0]

    def states(self, chunk: str) -> tuple[list[int], list[str | None]]:
        """Counts and last tokens at the prefixes 0..len(chunk), going on from the longest prefix at hand."""
        known, score, pairs = self.known, self.score, self.pairs
        for n in range(len(chunk), max(0, len(chunk) - 12), -1):
            if (got := known.get(chunk[:n])) is not None:
                if n == len(chunk):
                    return got
                counts, last = map(list, got)
                break
        else:
            n, counts, last = 0, [0], [None]
        ending = self.ending
        for i in range(n + 1, len(chunk) + 1):
            for size in ending.get(chunk[i - 3 : i], SHORT) if i > 2 else SHORT:
                if size > i:
                    continue
                token = chunk[i - size : i]
                if size == 1 or token in score:
                    before = last[i - size]
                    ok = pairs.get((before, token))
                    if ok is None:
                        ok = self.fits(before, token)
                    if ok:
                        last.append(token)
                        counts.append(counts[i - size] + (1 if token in score else len(token.encode("utf-8", "replace"))))
                        break
        return counts, last

    def chunks(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no token can cross: before spaces, around line ends."""
        if not text:
            return []
        seen = MARK + text.replace(" ", MARK)
        if MARK + MARK in seen or "\0" in seen or not self.newline_alone:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", seen)
        return [c for c in seen.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0") if c]

    def __missing(self, chunk: str) -> int:
        """The last count of a chunk, from those of the parts between letters that stand together in no piece."""
        n, at, beside = 0, 0, self.beside
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in beside:
                n += self.__part(chunk[at:k])
                at = k
        n += self.__part(chunk[at:])
        if len(chunk) <= 64 and len(self.total) < 2 * MEMO:  # the first words met hold the frequent ones
            self.total[chunk] = n
        return n

    def __part(self, part: str) -> int:
        got = self.known.get(part)
        if got is None:
            counts, last = self.states(part)
            got = tuple(counts), tuple(last)
            if len(part) <= 64 and len(self.known) < MEMO:
                self.known[part] = got
        return got[0][-1]

    def ends(self, chunks: list[str]) -> list[int]:
        """The token count of each chunk, computed by chunk() when not remembered."""
        got = list(map(self.total.get, chunks))
        return [self.__missing(c) if n is None else n for c, n in zip(chunks, got, strict=True)] if None in got else got

    def prefixes(self, text: str) -> list[int]:
        """Counts at all prefixes 0..len(text); entry k is the count of text[:k]."""
        out, base = [0], 0
        for c in self.chunks(text):
            counts = self.chunk(c)
            out += [base + n for n in counts[1:]]
            base += counts[-1]
        return [0] + out[2:] if text else [0]

    def fit(self, chunks: list[str], ends: list[int], budget: int) -> int:
        """Code points of the longest prefix with at most budget tokens. A longer prefix may need fewer tokens, so
        all prefixes count; those in a chunk need at least the tokens before it."""
        best, at = 0, 0
        for c, before in zip(chunks, accumulate(ends, initial=0), strict=False):
            if before > budget:
                break
            if before + len(c.encode("utf-8", "replace")) <= budget:  # no prefix has more tokens than bytes
                best = at + len(c)
            else:
                best = max([best, *(at + k for k, n in enumerate(self.chunk(c)) if before + n <= budget)])
            at += len(c)
        return max(0, best - 1)


def _counter(model):
    def make() -> PrefixCounter:
        return PrefixCounter(model.value)

    return make


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, prefix_tokens array<int>): entry k (from 0) is the token count of the first k code points."""
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    def make():
        counter = _counter(model)()
        return lambda ids, texts: {"doc_id": ids, "prefix_tokens": [counter.prefixes(t) for t in texts]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(id_and_text(docs, id_col, text_col), make, f"doc_id {kind}, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars code points, from stored counts; beyond the end, those of the whole text."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(prefix_tokens, F.least(F.greatest(n, F.lit(0)) + 1, F.size(prefix_tokens)).cast("int"))


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix with at most budget tokens, from stored counts."""
    return F.array_max(F.transform(prefix_tokens, lambda n, k: F.when(n <= budget, k).otherwise(0)))


def token_totals(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): the last prefix count of each text, and for the limit the
    longest prefix that keeps to it. Repeated words take their counts from a bounded memo of each worker."""
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    def make():
        counter = _counter(model)()

        def step(ids, texts):
            out: dict[str, list] = {"doc_id": ids, "n_bytes": [], "n_tokens": [], "over_limit": [], "fit_chars": []}
            for t in texts:
                chunks = counter.chunks(t)
                ends = counter.ends(chunks)
                n = sum(ends)
                out["n_bytes"].append(len(t.encode("utf-8", "replace")))
                out["n_tokens"].append(n)
                out["over_limit"].append(n > limit)
                out["fit_chars"].append(counter.fit(chunks, ends, limit) if n > limit else len(t))
            return out

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(id_and_text(docs, id_col, text_col), make, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
