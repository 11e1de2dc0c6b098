"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon is learnt: words that far more toxic than clean documents of the sample hold, weighted by the log
ratio. It is a trie; a token is read by an automaton whose state is the set of (trie node, edits so far) that
it may have come to, so one pass finds every entry within reach. States and their transitions are made when
first needed. A term of FUZZY letters or more may have one edit anywhere: a letter changed, left out or put in, or
two neighbours swapped. Tokens hold digits and inner marks ("id1ot", "st*pid"); in those that do, terms of MASKED
letters may have an edit, too. A token with marks is read as a whole and in its parts. Ordinary words of clean
documents that happen to lie one edit from a term are no misspellings.

For each hit a window of the text around tells quotation (quote marks on both sides, verbs of saying) from
abuse (address, exclamation). A logistic regression over sums of hits, densest window, quotation and abuse
gives the score; it learns from other documents of the sample than the lexicon does.

Defined cases: a null text is the empty text; texts without a hit share one score, the empty text included.
Without labels of both kinds all scores are 0. Equal texts score alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

#: About so many documents of each label, at most, are learnt from.
FIT_ROWS = 12_000
LEAST_DOCS, LEAST_WEIGHT = 3, math.log(6)
FUZZY, MASKED = 5, 4
WINDOW, SPAN = 12, 60
#: Tokens remembered, the longest of them, and automaton states kept at once.
MEMO, MEMO_LENGTH, STATES = 200_000, 32, 50_000
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[@$*]?[^\W_]+(?:[-'’.*@$!+|_][^\W_]+)*")
OPEN, CLOSE = re.compile("[\"“«„]"), re.compile("[\"”»“]")
# Cue words around a hit.
SAYING = re.compile(r"\b(said|says|wrote|quoted?|called|reported|replied|dit|écrit|sagte|schrieb|dijo)\b")
ABUSE = re.compile(r"\b(you|your|u|ur|du|dich|tu|toi|vous|tú|usted)\b|!")


class Automaton:
    """The lexicon as a trie, read by a lazily built deterministic automaton with at most one edit.

    A state is a set of (node, e): e is 0 or 1 edit so far, or 2 where two letters stand swapped and the second of
    them, which comes before the node's own in the term, must be read next.
    """

    def __init__(self, weights: dict[str, float], ordinary: frozenset[str] = frozenset()) -> None:
        self.weights, self.ordinary = weights, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.before: list[str] = [""]  # the letter before each node's own
        self.ends: dict[int, str] = {}
        for word in sorted(weights):
            node, last = 0, ""
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.before.append(last)
                node, last = self.children[node][c], c
            self.ends[node] = word
        self.memo: dict[str, tuple[str, int] | None] = {}
        self._fresh()

    def _fresh(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.numbers: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self._number({(0, 0)})

    def _number(self, items: set[tuple[int, int]]) -> int:
        """The state of these items and of those that leaving out a letter leads to; -1 if there are none."""
        for node, e in list(items):
            if e == 0:
                items |= {(n, 1) for n in self.children[node].values()}
        key = tuple(sorted(i for i in items if i[1] == 0 or (i[0], 0) not in items))
        if not key:
            return -1
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        items: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if e == 2:
                if c == self.before[node]:
                    items.add((node, 1))
                continue
            if c in self.children[node]:
                items.add((self.children[node][c], e))
            if e == 0:
                items.add((node, 1))
                for n in self.children[node].values():
                    items.add((n, 1))
                    if c in self.children[n]:
                        items.add((self.children[n][c], 2))
        return self._number(items)

    def read(self, token: str) -> tuple[str, int] | None:
        """The heaviest term with the fewest edits within reach of the token, and those edits."""
        if token in self.weights:
            return token, 0
        state = self.start
        for c in token:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        if token in self.ordinary:
            return None
        least = FUZZY if token.isalpha() else MASKED
        near = [w for node, e in self.states[state] if e == 1 and (w := self.ends.get(node)) and len(w) >= least]
        return (max(near, key=lambda w: (self.weights[w], w)), 1) if near else None

    def _match(self, token: str) -> tuple[str, int] | None:
        if token.isalpha():
            return self.read(token)
        parts = WORD.findall(token)
        exact = [p for p in (token, *parts) if p in self.weights]
        if exact:
            return max(exact, key=lambda w: (self.weights[w], w)), 0
        found = [hit for hit in (self.read(token), *map(self.read, parts)) if hit]
        return max(found, key=lambda h: (self.weights[h[0]], h[0])) if found else None

    def match(self, token: str) -> tuple[str, int] | None:
        """What ``token`` as a whole, or else a part of it between marks, stands for."""
        if token in self.memo:
            return self.memo[token]
        if len(self.states) >= STATES:
            self._fresh()
        hit = self._match(token)
        if len(token) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[token] = hit
        return hit


FEATURES = ("exact", "fuzzy", "top", "second", "densest", "quoted", "abusive", "kinds")


def features(text: str, automaton: Automaton) -> list[float] | None:
    """Of a text with hits, else None."""
    lower = text.lower()
    tokens = TOKEN.findall(lower)
    found = {t: hit for t in set(tokens) if (hit := automaton.match(t))}
    if not found:
        return None
    hits = [(i, m.start(), m.end(), *found[m[0]]) for i, m in enumerate(TOKEN.finditer(lower)) if m[0] in found]
    weigh = automaton.weights
    by_term: dict[str, float] = {}
    quoted = abusive = 0
    for _, a, b, term, edits in hits:
        by_term[term] = max(by_term.get(term, 0.0), weigh[term] * (1 - 0.5 * edits))
        left, right = lower[max(0, a - SPAN) : a], lower[b : b + SPAN]
        if (OPEN.search(left) and CLOSE.search(right)) or SAYING.search(left):
            quoted += 1
        if ABUSE.search(left) or ABUSE.search(right):
            abusive += 1
    best, densest, total, first = sorted(by_term.values(), reverse=True), 0.0, 0.0, 0
    worth = [weigh[h[3]] * (1 - 0.5 * h[4]) for h in hits]
    for j, h in enumerate(hits):  # the heaviest run of WINDOW words
        total += worth[j]
        while h[0] - hits[first][0] >= WINDOW:
            total -= worth[first]
            first += 1
        densest = max(densest, total)
    exact = sum(weigh[t] for t in {h[3] for h in hits if not h[4]})
    fuzzy = sum(weigh[t] for t in {h[3] for h in hits if h[4]} - {h[3] for h in hits if not h[4]})
    return [math.log1p(exact), math.log1p(fuzzy), best[0], best[1] if len(best) > 1 else 0.0, math.log1p(densest), quoted / len(hits), abusive / len(hits), len(by_term) / math.sqrt(len(tokens))]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: list[Counter[str]] = [Counter(), Counter()]
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(WORD.findall(text.lower())))
    words = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[w] for w in part], pa.int64()) for c in counts)], names=["word", "n0", "n1"])


class Model:
    def __init__(self, automaton: Automaton, middle: np.ndarray, spread: np.ndarray, weights: np.ndarray, rest: float) -> None:
        self.automaton, self.middle, self.spread, self.weights, self.rest = automaton, middle, spread, weights, rest

    def score(self, text: str) -> float:
        f = features(text, self.automaton)
        if f is None:
            return self.rest
        z = float(((np.array(f) - self.middle) / self.spread) @ self.weights[1:] + self.weights[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, weights with the constant first) by Newton's method."""
    middle, spread = x.mean(0), x.std(0) + 1e-6
    a = np.c_[np.ones(len(x)), (x - middle) / spread]
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return middle, spread, w


def train(docs: DataFrame, labels: DataFrame, where: Column) -> Model | None:
    """Learn lexicon and regression from a bounded sample of the labelled rows that ``where`` admits."""
    rows = labelled.sample(docs, labels, "toxic", where, FIT_ROWS)
    first = rows.filter("part < 6")
    n = {r["label"]: r["n"] for r in first.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    counted = first.mapInArrow(common.lean(_vocabulary), "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    weight = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    counted = common.cut(counted.withColumn("weight", weight))
    terms = counted.filter((F.col("n1") >= LEAST_DOCS) & (F.col("weight") >= LEAST_WEIGHT))
    lexicon = {r["word"]: float(r["weight"]) for r in terms.select("word", "weight").collect()}
    plain = Automaton(lexicon)

    def common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column("word").to_pylist() if plain.read(w)], pa.string())], names=["word"])

    usual = counted.filter((F.col("n0") >= 2) & (F.col("weight") < LEAST_WEIGHT)).select("word").mapInArrow(common.lean(common_words), "word string")
    automaton = Automaton(lexicon, frozenset(r["word"] for r in usual.collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label")], names=["f", "label"])

    seen = rows.filter("part >= 6").select("text", "label").mapInArrow(common.lean(measured), "f array<double>, label int").collect()
    hit = [r for r in seen if r["f"] is not None]
    missed = [r["label"] for r in seen if r["f"] is None]
    rest = (sum(missed) + 0.01) / (len(missed) + 1)
    x, y = np.array([r["f"] for r in hit]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in hit], float)
    if not 0 < y.sum() < len(y):
        return Model(automaton, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.r_[float(y.sum() > 0) * 4 - 2, np.zeros(len(FEATURES))], min(rest, 0.49))
    return Model(automaton, *logistic(x, y), rest)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each document."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.steps(batches):
            got = [model.score(t.decode("utf-8", "surrogatepass")) if model else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return common.text_of(docs).mapInArrow(common.lean(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The documents whose score is below ``least``, with their columns."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model is None or model.score(t or "") < least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(common.lean(run), docs.schema)


def learners() -> Column:
    return common.fold(F.col("doc_id"), 5) != 0


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learners())
    rows = score(docs, model)
    return rows.select("doc_id", (~learners()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
