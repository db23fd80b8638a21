"""Toxicity scores from a learned lexicon, matched through Levenshtein automata, with context windows.

Terms that labelled toxic documents use and others do not form a trie. The trie is intersected with
the Levenshtein automata of its terms, as a deterministic automaton whose states are made when first
met: one pass over a word tells whether it is a term or a misspelling of one. A letter too many, too
few, wrong, or changed with its neighbour is an error, at the start too; terms of five letters may
have one, of nine two. Words that clean training documents use are themselves and misspell nothing.
Each hit is read in its window of words: quotation marks, words of reporting, direct address and
exclamation are weighed as the training documents teach. A logistic regression over the hits' masses
gives the score. Labels, language and source are never looked at when scoring.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shingles import task, texts_of, worker_cache
from waymark.plans.storage import drop, save

#: Labelled rows of each class that the model is fitted on, at most.
TOXIC_ROWS, CLEAN_ROWS = 6_000, 12_000
#: The evidence (log-likelihood ratio, odds) that a term needs, and clean documents that make a word ordinary.
LEAST_LLR, LEAST_LOG_ODDS, ORDINARY = 25.0, 2.0, 2
WINDOW = 6
CACHE = 300_000

# Marks and words that tell quotation and address, in the languages served.
QUOTES = "\"“”„«»‘’‚‹›`"
STRIP = ".,;:!?…¡¿()[]{}<>*#$%&|/\\_-'" + QUOTES
REPORTING = frozenset("said says say wrote writes called quote quoted quotes term word words slur reported allegedly "
                      "sagte sagt schrieb nannte zitat wort dit disait appelé citation mot dijo dice escribió llamó cita palabra".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu toi te ton ta vous votre tú te usted ustedes eres".split())


def errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic on the way."""

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset()) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most = [0]  # errors that a term below the node may have
        for i, t in enumerate(terms):
            node, k = 0, errors(t)
            self.most[0] = max(self.most[0], k)
            for ch in t:
                child = self.next[node].get(ch)
                if child is None:
                    child = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = child
                self.most[node] = max(self.most[node], k)
            self.term[node] = i
        self.terms, self.ordinary = terms, ordinary
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.plain: set[str] = set()  # words as they stand, known to be no hits
        start: dict[tuple[int, str], int] = {}
        self._add(start, 0, 0)
        self._state(start)

    def _add(self, new: dict[tuple[int, str], int], node: int, e: int) -> None:
        if e <= self.most[node] and e < new.get((node, ""), 99):
            new[node, ""] = e
            for child in self.next[node].values():  # a letter of the term is missing
                self._add(new, child, e + 1)

    def _state(self, new: dict[tuple[int, str], int]) -> int:
        if not new:
            return -1
        key = tuple(sorted(new.items()))
        got = self.names.get(key)
        if got is None:
            got = self.names[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for (n, due), e in key if not due and self.term[n] >= 0 and e <= errors(self.terms[self.term[n]])]
            self.final.append((min(ends)[1], min(ends)[0]) if ends else None)
        return got

    def _step(self, state: tuple, ch: str) -> int:
        """The state after ``ch``; -1 if no term can follow. Of two changed letters, the one due is kept."""
        new: dict[tuple[int, str], int] = {}
        for (node, due), e in state:
            if due:
                if due == ch:
                    self._add(new, node, e)
                continue
            child = self.next[node].get(ch)
            if child is not None:
                self._add(new, child, e)
            if e < self.most[node]:
                self._add(new, node, e + 1)
                for first, child in self.next[node].items():
                    self._add(new, child, e + 1)
                    after = self.next[child].get(ch)
                    if after is not None and first != ch and e < min(self.most[after], new.get((after, first), 99) - 1):
                        new[after, first] = e + 1
        return self._state(new)

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term within its errors, as (term, errors), or None."""
        if len(self.states) > CACHE // 4:
            self.reset()
        s = 0
        for ch in word:
            to = self.moves[s].get(ch)
            if to is None:
                to = self.moves[s][ch] = self._step(self.states[s], ch)
            s = to
            if s < 0:
                break
        got = self.final[s] if s >= 0 else None
        return None if got and got[1] and word in self.ordinary else got


MARKS = frozenset(QUOTES)

#: What speaks for abuse (log odds) before any document is seen: always, quotation marks around, reporting, address, exclamation.
CONTEXT = (2.0, -2.5, -1.5, 1.0, 0.5)


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    weights: tuple[float, ...]  # of the terms
    coefficients: tuple[float, ...]  # of the features, the intercept last
    ordinary: frozenset[str] = frozenset()  # words near a term that clean documents use
    context: tuple[float, ...] = CONTEXT


N_FEATURES = 5
_AUTOMATA: dict[tuple, LexiconAutomaton] = worker_cache("toxicity")


def automaton(terms: tuple[str, ...], ordinary: frozenset[str] = frozenset()) -> LexiconAutomaton:
    if (terms, ordinary) not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[terms, ordinary] = LexiconAutomaton(list(terms), ordinary)
    return _AUTOMATA[terms, ordinary]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def signs(words: list[str], i: int) -> tuple[bool, ...]:
    """What the window around word ``i`` holds: quotation marks on both sides, reporting, address, exclamation."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    half = len(words[i]) // 2
    before, after = "".join(words[lo:i]) + words[i][:half], words[i][half:] + "".join(words[i + 1 : hi])
    quoted = not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after)
    near = [w.strip(STRIP) for w in words[lo:hi]]
    return quoted, not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near), "!" in words[i] or "!" in after


def quoted_share(window: tuple[bool, ...], context: tuple[float, ...] = CONTEXT) -> float:
    """How far the signs of a window speak for a quotation (1) and against abuse (0)."""
    return 1 / (1 + math.exp(context[0] + sum(c for c, on in zip(context[1:], window, strict=True) if on)))


def hits_of(words: list[str], lexicon: LexiconAutomaton) -> dict[str, tuple[int, int]]:
    hits = {}
    for w in set(words) - lexicon.plain:
        core = w.strip(STRIP)
        got = lexicon.match(core) if core else None
        if got:
            hits[w] = got
        else:
            lexicon.plain.add(w)
    if len(lexicon.plain) > CACHE:
        lexicon.plain.clear()
    return hits


#: What a window may hold: all choices of its signs.
WINDOWS = [tuple(bool(k >> j & 1) for j in range(4)) for k in range(16)]


def masses(text: str | None, lexicon: LexiconAutomaton, weights: tuple[float, ...]) -> np.ndarray | None:
    """Weights of the hits by window, exact then misspelled; then distinct exact terms, and hits in the densest window.

    None for a text without hits.
    """
    words = words_of(text or "")
    hits = hits_of(words, lexicon)
    if not hits:
        return None
    out = np.zeros(2 * len(WINDOWS) + 2)
    at = []
    for i, w in enumerate(words):
        got = hits.get(w)
        if got:
            out[sum(on << k for k, on in enumerate(signs(words, i))) + len(WINDOWS) * (got[1] > 0)] += weights[got[0]]
            at.append(i)
    dense, lo = 0, 0
    for hi in range(len(at)):
        while at[hi] - at[lo] > 10 * WINDOW:
            lo += 1
        dense = max(dense, hi - lo + 1)
    out[-2:] = len({t for t, e in hits.values() if not e}), dense
    return out


def weigh(mass: np.ndarray, context: tuple[float, ...] = CONTEXT) -> np.ndarray:
    """Features from rows of :func:`masses`: abuse exact and misspelled, quotation, distinct terms, densest window."""
    q = np.array([quoted_share(w, context) for w in WINDOWS])
    n = len(WINDOWS)
    exact, fuzzy = mass[:, :n], mass[:, n : 2 * n]
    return np.log1p(np.c_[exact @ (1 - q), fuzzy @ (1 - q), (exact + fuzzy) @ q, mass[:, -2:]])


def features(text: str | None, lexicon: LexiconAutomaton, weights: tuple[float, ...], context: tuple[float, ...] = CONTEXT) -> tuple[float, ...]:
    """Features of a text, as the regression reads them; all zero for one without hits."""
    got = masses(text, lexicon, weights)
    return (0.0,) * N_FEATURES if got is None else tuple(weigh(got[None, :], context)[0].tolist())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression; the intercept, last, is not penalised."""
    pen = np.r_[np.full(x.shape[1], ridge), 1e-6]
    return _newton(np.c_[x, np.ones(len(x))], y, np.ones(len(x)), pen, np.zeros(len(pen)), rounds)


def _newton(x: np.ndarray, y: np.ndarray, often: np.ndarray, pen: np.ndarray, prior: np.ndarray, rounds: int) -> np.ndarray:
    """Logistic regression of rows met ``often``, its weights drawn to ``prior`` by ``pen``."""
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (often * (y - p)) - pen * (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_context(rows: list[tuple[tuple[bool, ...], int, int]], n1: int, n0: int) -> tuple[float, ...]:
    """Weights of a window's signs from (signs, label, documents with such a hit), drawn to ``CONTEXT``.

    Each class counts alike, as many documents as there are of the rarer one.
    """
    if not rows:
        return CONTEXT
    x = np.array([[1.0, *map(float, s)] for s, _, _ in rows])
    y = np.array([float(label) for _, label, _ in rows])
    often = np.array([n * min(n1, n0) / (n1 if label else n0) for _, label, n in rows])
    return tuple(_newton(x, y, often, np.full(x.shape[1], 4.0), np.array(CONTEXT), 60).tolist())


def _llr(a, b, n1, n0):
    """Log-likelihood ratio of a term found in ``a`` of ``n1`` toxic and ``b`` of ``n0`` clean documents."""
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    p = (a + b) / F.lit(float(n1 + n0))
    return 2 * (part(a, n1, p) + part(b, n0, p) + part(n1 - a, n1, 1 - p) + part(n0 - b, n0, 1 - p))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn lexicon and coefficients from at most TOXIC_ROWS + CLEAN_ROWS labelled documents.

    Rows with null ids, texts or labels are left out; of several labels of an id the larger counts.
    Without documents of both classes the model scores every text 0.
    """
    y = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = y.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(y.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = save(rows.join(F.broadcast(picked), "doc_id").select("text", "y"), "toxic-train")  # 18,000 ids at most are sent
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel((), (), (0.0,) * N_FEATURES + (-40.0,))

    @task("toxicity")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[label].update({w.strip(STRIP) for w in set(words_of(text))} - {""})
            every = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([found[1][w] for w in every], pa.int64()), pa.array([found[0][w] for w in every], pa.int64())], names=["word", "a", "b"])

    found = save(rows.mapInArrow(count, "word string, a bigint, b bigint").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("length(word) <= 43"), "toxic-words")
    odds = F.log((F.col("a") + 0.5) / (n1 + 1.0)) - F.log((F.col("b") + 0.5) / (n0 + 1.0))
    strong = found.where("a >= 3 and length(word) between 3 and 40").select("word", odds.alias("w"), _llr(F.col("a").cast("double"), F.col("b").cast("double"), n1, n0).alias("llr"))
    best = strong.where((F.col("llr") >= LEAST_LLR) & (F.col("w") >= LEAST_LOG_ODDS)).orderBy("word").collect()  # words of the bounded sample
    terms, weights = tuple(r["word"] for r in best), tuple(float(r["w"]) for r in best)

    @task("toxicity")
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([w for w in words if (got := automaton(terms).match(w)) and got[1]], pa.string())], names=["word"])

    plain = found.where((F.col("b") >= ORDINARY) & (odds < LEAST_LOG_ODDS)).select("word")
    ordinary = frozenset(r["word"] for r in plain.mapInArrow(near, "word string").collect()) if terms else frozenset()  # words of the sample, near terms only
    drop(found)

    n_masses = 2 * len(WINDOWS) + 2
    names = [f"m{i}" for i in range(n_masses)]

    @task("toxicity")
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.zeros((b.num_rows, n_masses))
            for k, texts in texts_of(b, 0):
                for i, t in enumerate(texts):
                    found = masses(t, automaton(terms, ordinary), weights)
                    if found is not None:
                        got[k + i] = found
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in got.T), b.column(1).cast(pa.int64())], names=[*names, "y"])

    data = rows.mapInArrow(describe, ", ".join(f"{m} double" for m in names) + ", y bigint").toPandas().to_numpy(float)  # the bounded sample
    drop(rows)
    data = data[np.lexsort(data.T)]
    mass, y = data[:, :-1], data[:, -1]
    has = mass[:, : len(WINDOWS)] + mass[:, len(WINDOWS) : -2] > 0
    context = learn_context([(w, label, n) for k, w in enumerate(WINDOWS) for label in (0, 1) if (n := int(has[y == label, k].sum()))], n1, n0)
    return ToxicityModel(terms, weights, tuple(logistic(weigh(mass, context), y).tolist()), ordinary, context)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``score`` (double) and ``predicted`` (int) appended.

    A null or empty text scores as one without hits. Columns named like these are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    rows = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "score double, predicted int"])
    at = keep.index(text_col)

    @task("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.coefficients)
        for b in batches:
            z = np.full(b.num_rows, w[-1])
            for k, texts in texts_of(b, at):
                for i, t in enumerate(texts):
                    found = masses(t, automaton(model.terms, model.ordinary), model.weights)
                    if found is not None:
                        z[k + i] += (weigh(found[None, :], model.context) @ w[:-1])[0]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id's text leaves 1 on division by 3."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; fitted on labels that are not held out."""
    model = fit(docs, labels.where(~held_out()))
    rows = score(docs.select("doc_id", "text"), model, threshold)
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")
