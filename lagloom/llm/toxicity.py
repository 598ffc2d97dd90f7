"""Toxicity from a learned lexicon, met by Levenshtein automata on its trie, weighed by context.

Learning: on a bounded sample of labelled documents, words and word beginnings are counted by label; those that stand
out beyond chance become terms with log-odds weights and form a trie. Scoring: the Levenshtein automaton of distance
one runs over the trie, made deterministic as words are read, so a word costs one look-up a letter and most words leave
the automaton after a few. Long terms match with one error, short terms and beginnings exactly; a near word that
is ordinary in clean documents is no match. A hit weighs less inside quotation marks or beside a verb of reporting and
more beside an address. A logistic function of a document's evidence, fitted on the sample, gives the score.

Labels, language, source and id are no input of a score. Null and empty texts have no evidence and get the score of
that; if the sample has no toxic or no clean document, nothing is learned and every score is the smoothed base rate.
Rows are scored on their own, so repeated ones get equal scores. A document counts once in learning: of rows that share an
id the least text is read, and one label of several that says toxic is enough.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm.common import MEMO, hand_back, id_and_text, map_columns, stored

#: Labelled documents to learn from at most (by hash of the id). Whatever is learned (terms, ordinary words near them) is
#: words of these documents, all that the tests leave.
SAMPLE = 20_000
#: Letters of a word beginning that can be a term; letters from which a term may have one error.
BEGINNINGS, FUZZY = (4, 5, 6), 5
#: Words beside a hit that are looked at.
SPAN = 6
#: Look-alike characters in disguised words.
LOOKALIKES = str.maketrans("@013457$|!", "aoieastsli")
#: Verbs of reporting, words of address.
REPORTING = frozenset("said says wrote writes called quoted quote quoting reported dit écrit appelé sagte schrieb nannte zitat dijo escribió llamó cita".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu toi vous votre du dich dein sie ihr tú usted eres vosotros".split())
WORD = re.compile(r"\w+")
QUOTES = re.compile("[\"“”«»„]")
OUT, EXACT, START, NEAR = 0, 1, 2, 3


class Matcher:
    """The automaton of all words within the allowed distance of a lexicon, built state by state when met.

    A state is a set of (trie node, errors). Reading a letter follows the arc of that letter; with an error to spare
    it may also take any arc (a wrong letter), stay (a letter too many), or skip an arc first (a letter missing)."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.arcs: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.start: dict[int, str] = {}
        self.fuzzy: list[bool] = [False]
        for table, terms in ((self.word, words), (self.start, starts)):
            for t in terms:
                at = 0
                for c in t:
                    if c not in self.arcs[at]:
                        self.arcs.append({})
                        self.fuzzy.append(False)
                        self.arcs[at][c] = len(self.arcs) - 1
                    at = self.arcs[at][c]
                    self.fuzzy[at] |= table is self.word and len(t) >= FUZZY
                table[at] = t
        self.weights = words | starts
        self.ordinary = ordinary
        self.fresh()

    def fresh(self) -> None:
        first = frozenset({(0, 0)} | {(n, 1) for n in self.arcs[0].values() if self.fuzzy[n]})
        self.states, self.ids, self.next, self.hit = [first], {first: 0}, {}, [(OUT, "", OUT, "")]

    def step(self, state: int, letter: str) -> int:
        """The state after a letter; -1 if no word of the automaton goes on so."""
        found = set()
        for node, errors in self.states[state]:
            arcs = self.arcs[node]
            if (n := arcs.get(letter)) is not None and (not errors or self.fuzzy[n]):
                found.add((n, errors))
                if not errors:
                    found |= {(m, 1) for m in self.arcs[n].values() if self.fuzzy[m]}
            if not errors:
                found |= {(n, 1) for n in arcs.values() if self.fuzzy[n]}
                if node == 0 or self.fuzzy[node]:
                    found.add((node, 1))
        key = frozenset(found)
        if not key:
            new = -1
        elif (new := self.ids.get(key, -1)) < 0:
            new = self.ids[key] = len(self.states)
            self.states.append(key)
            self.hit.append(self._accept(key))
        self.next[state, letter] = new
        return new

    def _accept(self, state: frozenset) -> tuple[int, str, int, str]:
        """(kind, term) of a word that ends here, (kind, term) of one that has come so far."""
        exact = [self.word[n] for n, e in state if n in self.word and not e]
        near = [self.word[n] for n, e in state if n in self.word and e and len(self.word[n]) >= FUZZY]
        start = [self.start[n] for n, e in state if n in self.start and not e]
        end = (EXACT, exact[0]) if exact else (NEAR, min(near)) if near else (OUT, "")
        return (*end, START if start else OUT, start[0] if start else "")

    def match(self, word: str) -> tuple[int, str]:
        """How a word is met, and the term: exactly, by its beginning, nearly, or not."""
        if len(self.states) > MEMO:
            self.fresh()
        state, begun = 0, (OUT, "")
        for c in word:
            new = self.next.get((state, c))
            state = self.step(state, c) if new is None else new
            if state < 0:
                return begun
            if self.hit[state][2]:
                begun = self.hit[state][2:]
        kind, term = self.hit[state][:2]
        if kind == EXACT or not begun[0]:
            return (OUT, "") if kind == NEAR and word in self.ordinary else (kind, term)
        return begun


class Scorer:
    """Evidence of texts: (weighed hits, share of hits among words, near hits, quoted hits)."""

    def __init__(self, matcher: Matcher):
        self.matcher, self.memo = matcher, {}

    def chunk(self, chunk: str) -> tuple:
        """The hits of a lower-cased piece between white space: (kind, term) each."""
        plain = [self.matcher.match(w) for w in WORD.findall(chunk)]
        hits = tuple(h for h in plain if h[0])
        if not hits and not chunk.isalpha():
            undone = "".join(WORD.findall(chunk.translate(LOOKALIKES)))
            hit = self.matcher.match(undone)
            hits = (hit,) if hit[0] == EXACT else ()
        if len(self.memo) < 2 * MEMO and len(chunk) <= 64:
            self.memo[chunk] = hits
        return hits

    def evidence(self, text: str) -> tuple[float, float, float, float]:
        chunks = text.lower().split()
        got = list(map(self.memo.get, chunks))
        if None in got:
            got = [self.chunk(c) if g is None else g for c, g in zip(chunks, got, strict=True)]
        if not any(got):
            return 0.0, 0.0, 0.0, 0.0
        opened = np.cumsum([len(QUOTES.findall(c)) for c in chunks]) if QUOTES.search(text) else None
        total = near = quoted = n = 0.0
        for k, hits in enumerate(got):
            if not hits:
                continue
            beside = [w for c in chunks[max(0, k - SPAN) : k + SPAN + 1] for w in WORD.findall(c)]
            marked = opened is not None and (opened[k] % 2 == 1 or len(QUOTES.findall(chunks[k])) > 1 or (opened[k] != (opened[k - 1] if k else 0)))
            if marked or not REPORTING.isdisjoint(beside):
                context, quoted = 0.25, quoted + len(hits)
            else:
                context = 1.0 if ADDRESS.isdisjoint(beside) else 1.5
            for kind, term in hits:
                near += kind == NEAR
                total += context * self.matcher.weights[term] * (0.7 if kind == NEAR else 1.0)
            n += len(hits)
        return total, n / len(chunks), near, quoted


def features_of(total: float, share: float) -> tuple[float, float, float]:
    return 1.0, math.log1p(total), math.sqrt(share)


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic): labelled documents, a bounded number in the order of a hash of the id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stored(texts.select("doc_id", "text", "toxic"), "labelled-sample")


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, n_toxic, n_clean): in how many documents each word and word beginning ('begin*') is."""

    def make():
        def step(texts, toxic):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(texts, toxic, strict=True):
                words = set(WORD.findall(t.lower()))
                n[y].update(words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k})
            both = list(n[0].keys() | n[1].keys())
            return {"feature": both, "n_toxic": [n[1][f] for f in both], "n_clean": [n[0][f] for f in both]}

        return step

    rows = map_columns(sample.select("text", "toxic"), make, "feature string, n_toxic long, n_clean long")
    return rows.groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


class Model:
    """A fitted lexicon with its logistic weights; small, and shipped to the workers as it is."""

    def __init__(self, words, starts, ordinary, weights):
        self.words, self.starts, self.ordinary, self.weights = words, starts, ordinary, weights

    def scorer(self) -> Scorer:
        return Scorer(Matcher(self.words, self.starts, self.ordinary))

    def score(self, total: float, share: float) -> float:
        z = sum(w * x for w, x in zip(self.weights, features_of(total, share), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * w * np.array([0.01, 1, 1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge * np.array([0.01, 1, 1])), x.T @ (y - p) - pull)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled documents; docs has doc_id and text, and only those to learn from."""
    known = _sample(docs, labels, sample)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    base = [math.log((bad + 0.5) / (good + 0.5)), 0.0, 0.0]
    if not bad or not good:
        return Model({}, {}, frozenset(), base)
    counts = stored(_counts(known), "term-counts")
    # a term is more toxic than the base rate by more than the best of so many features would be by chance
    p, q, here = bad / (bad + good), F.col("n_toxic") / (F.col("n_toxic") + F.col("n_clean")), F.col("n_toxic") + F.col("n_clean")
    gain = here * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0))
    beyond = math.log(max(2, counts.count())) + math.log(20)
    terms = counts.where((F.col("n_toxic") >= 3) & (q >= F.lit(min(0.7, 4 * p)))).withColumn("gain", gain).where(F.col("gain") > beyond)
    terms = terms.collect()
    weight = {r.feature: math.log((r.n_toxic + 0.5) / (bad + 1)) - math.log((r.n_clean + 0.5) / (good + 1)) for r in terms}
    words = {f: w for f, w in weight.items() if not f.endswith("*")}
    starts = {f[:-1]: w for f, w in weight.items() if f.endswith("*")}
    # words one error away from a term that clean documents use are ordinary
    matcher = Matcher(words, {})

    def make():
        def step(words):
            return {"word": [w for w in words if matcher.match(w)[0] == NEAR]}

        return step

    common = counts.where(~F.col("feature").endswith("*") & (F.col("n_clean") >= 2) & (q < 0.5)).select("feature")
    ordinary = frozenset(r.word for r in map_columns(common, make, "word string").collect())
    model = Model(words, starts, ordinary, base)
    seen = evidence(known, model, "toxic").select("total", "share", "toxic").toPandas()  # numbers of the sample
    x = np.array([features_of(t, s) for t, s in zip(seen.total, seen.share, strict=True)])
    model.weights = _logistic(x, seen.toxic.to_numpy(float))
    return model


def evidence(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """(doc_id, total, share, near, quoted, score) of docs (doc_id, text), and the columns carried along."""

    def make():
        scorer = model.scorer()

        def step(ids, texts, *others):
            found = [scorer.evidence(t) for t in texts]
            cols = dict(zip(("total", "share", "near", "quoted"), zip(*found, strict=True), strict=True))
            return {"doc_id": ids, **{c: list(v) for c, v in cols.items()}, "score": [model.score(f[0], f[1]) for f in found], **dict(zip(carried, others, strict=True))}

        return step

    kind = lambda c: f"{c} {docs.schema[c].dataType.simpleString()}"
    fields = [kind("doc_id"), "total double, share double, near double, quoted double, score double", *map(kind, carried)]
    return map_columns(docs.select("doc_id", "text", *carried), make, ", ".join(fields))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, near, quoted): learned from rows whose crc32 of the id is not 0 modulo 5."""
    texts = id_and_text(docs)
    model = fit(texts.where(~held_out(F.col("doc_id"))), labels, sample)
    scored = evidence(texts, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("near").cast("long").alias("n_near"), F.col("quoted").cast("long").alias("n_quoted"),
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose texts score below 0.5, with all their columns."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([model.score(*scorer.evidence(t or "")[:2]) for t in texts], dtype="float64")
        del scorer
        hand_back()

    return docs.where(score(F.col(text_col)) < 0.5)
