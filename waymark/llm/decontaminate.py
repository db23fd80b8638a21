"""Benchmark items found in training texts: BM25 over an inverted index of items, block-max WAND.

Items are indexed once, with impacts divided by the item's own score, so that an item found whole
scores 1 and one threshold serves all. Every training text is cut into overlapping passages, each of
which can hold any item whole, and every passage is a query. Terms without which an item cannot
reach the threshold (its heaviest) open the search: a passage with none of them is done. The others
run WAND over posting lists in blocks: bounds of terms find the pivot, bounds of blocks confirm or
skip it, and only then is an item scored. What is retrieved must then hold the item's question and
its answer, by overlap of word trigrams each.

The index is built per slice of items, so that no task holds more than ``INDEX_ROWS`` postings
however large the benchmark is; document frequencies are counted over all items.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shingles import task, texts_of, worker_cache
from waymark.plans.storage import save

K1, B = 1.2, 0.75
INDEX_ROWS = 2_000_000
BLOCK, GRAM, LEAST_WINDOW = 32, 3, 64

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item without its last sentence, and of that; of a single sentence the last third."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    k = max(1, len(words) * 2 // 3)
    return words[:k], words[k:] or words[-1:]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], words: list[str]) -> float:
    """Share of the part's word grams that the passage has."""
    want = grams(part)
    return len(want & grams(words, min(GRAM, len(part)))) / len(want) if want else 1.0


class Index:
    """Posting lists of one slice of items, in blocks, with the largest impact of each list and block."""

    def __init__(self, postings: list[tuple[int, str, float]], threshold: float) -> None:
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        items: dict[int, list[tuple[float, str]]] = defaultdict(list)
        for item, term, impact in postings:
            lists[term].append((item, impact))
            items[item].append((impact, term))
        self.threshold = threshold
        self.items: dict[str, list[int]] = {}
        self.impacts: dict[str, list[float]] = {}
        self.most: dict[str, float] = {}
        self.block_most: dict[str, list[float]] = {}
        for term, got in lists.items():
            got.sort()
            self.items[term], self.impacts[term] = [i for i, _ in got], [w for _, w in got]
            self.block_most[term] = [max(self.impacts[term][b : b + BLOCK]) for b in range(0, len(got), BLOCK)]
            self.most[term] = max(self.block_most[term])
        # the lightest terms of an item, half of the threshold together at most, cannot bring it there:
        # what its other (essential) terms must add at least is known
        self.essential: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.least: dict[int, float] = {}
        for item, got in items.items():
            got.sort()
            light = 0.0
            for impact, term in got:
                if light + impact < threshold / 2:
                    light += impact
                else:
                    self.essential[term].append((item, impact))
            self.least[item] = threshold - light - 1e-9

    def possible(self, terms: set[str]) -> set[str]:
        """Essential terms of the items that any choice of these terms could bring to the threshold."""
        have = terms & self.essential.keys()
        sums: dict[int, float] = defaultdict(float)
        for t in have:
            for item, impact in self.essential[t]:
                sums[item] += impact
        items = {i for i, s in sums.items() if s >= self.least[i]}
        return {t for t in have if any(i in items for i, _ in self.essential[t])} if items else set()

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """All items that these terms score at or over the threshold, by block-max WAND."""
        least = self.threshold - 1e-9
        at = [[self.items[t][0], 0, t] for t in terms if t in self.items]
        found = []
        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(at):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            # bounds of the blocks in which the pivot would stand, and where the next of them ends
            bound, until = 0.0, at[pivot + 1][0] if pivot + 1 < len(at) else None
            for k in range(pivot + 1):
                _, pos, t = at[k]
                ids = self.items[t]
                where = bisect.bisect_left(ids, item, pos)
                if where < len(ids):
                    block = where // BLOCK
                    bound += self.block_most[t][block]
                    end = ids[min(len(ids), (block + 1) * BLOCK) - 1] + 1
                    until = end if until is None else min(until, end)
            if bound < least:  # no item before the end of these blocks can reach the threshold
                goal = max(item + 1, until if until is not None else item + 1)
            else:
                score = 0.0
                for k in range(pivot + 1):
                    _, pos, t = at[k]
                    ids = self.items[t]
                    where = bisect.bisect_left(ids, item, pos)
                    if where < len(ids) and ids[where] == item:
                        score += self.impacts[t][where]
                if score >= least:
                    found.append((item, score))
                goal = item + 1
            rest = []
            for k, (_, pos, t) in enumerate(at):
                if k <= pivot:
                    pos = bisect.bisect_left(self.items[t], goal, pos)
                    if pos == len(self.items[t]):
                        continue
                rest.append([self.items[t][pos], pos, t])
            at = rest
        return found


def item_postings(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, item_id, text, n_words, term, impact``: BM25 impacts of all items, summing to 1 for each."""
    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("key", F.xxhash64("item_id", "text"))

    @task("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, t, n, len(words)) for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for words in [words_of(text)] for t, n in Counter(words).items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "term", "tf", "n_words"])

    tf = save(rows.select("key", "text").mapInArrow(run, "key bigint, term string, tf bigint, n_words bigint"), "item-terms")
    size = tf.select("key", "n_words").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean")).first()
    if not size["n"]:
        return tf.select("key", F.lit(0).cast("bigint").alias("item_id"), "term", F.lit(0.0).alias("impact"), "n_words", F.lit("").alias("text"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(size["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    raw = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(float(size["mean"]))))
    scored = tf.join(df, "term").select("key", "term", "n_words", raw.alias("raw"))
    whole = scored.groupBy("key").agg(F.sum("raw").alias("whole"))
    return scored.join(whole, "key").join(rows, "key").select("key", "item_id", "text", "n_words", "term", (F.col("raw") / F.col("whole")).alias("impact"))


LEAK = "array<struct<item_id:bigint,bm25:double,question:double,answer:double,at:int>>"


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``leaks`` appended: the items that each text holds.

    Of each item: its id, best passage's score, the shares of question and answer found there, and
    the passage's first word. Null and empty texts, and items without words, take part in nothing;
    items repeated in id and text count once. A column named ``leaks`` is replaced.
    """
    names = [c for c in docs.columns if c != "leaks"]
    postings = save(item_postings(items, item_id, item_text), "item-postings")
    n = postings.count()
    slices = max(1, -(-n // INDEX_ROWS))
    out = docs.select(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for k in range(slices):  # an item's postings lie in one slice
        rows = postings.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k).select("key", "item_id", "text", "n_words", "term", "impact").collect()
        keys = sorted({r["key"] for r in rows})
        number = {key: i for i, key in enumerate(keys)}
        texts = {number[r["key"]]: (r["item_id"], r["text"]) for r in rows}
        window = max([LEAST_WINDOW, *(2 * r["n_words"] for r in rows)])
        shared = out.sparkSession.sparkContext.broadcast(([(number[r["key"]], r["term"], r["impact"]) for r in rows], texts))
        out = out.mapInArrow(_search(shared, window, threshold, question, answer, names.index(text_col), names, k), f"{fields}, leaks {LEAK}")
    return out


_INDEXES: dict[str, tuple[Index, dict]] = worker_cache("decontaminate")


def _search(shared, window: int, threshold: float, question: float, answer: float, at: int, names: list[str], step: int):
    key = uuid.uuid4().hex
    leak_type = pa.list_(pa.struct([("item_id", pa.int64()), ("bm25", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("at", pa.int32())]))

    def leaks_of(text: str, index: Index, parts: dict) -> list[dict]:
        words = words_of(text)
        best: dict[int, dict] = {}
        essential = index.possible(set(words))
        if not essential:
            return []
        known = [i for i, w in enumerate(words) if w in essential]
        last = -1
        for hit in known:
            # the passages that hold this word, each once
            for s in range(max(0, (hit - window) // (window // 2) + 1), hit // (window // 2) + 1):
                if s <= last:
                    continue
                last = s
                lo = s * (window // 2)
                passage = words[lo : lo + window]
                terms = set(passage)
                for item, score in index.search(terms) if index.possible(terms) else ():
                    if item in best and best[item]["bm25"] >= score:
                        continue
                    item_id, q, a = parts[item]
                    share_q, share_a = overlap(q, passage), overlap(a, passage)
                    if share_q >= question and share_a >= answer:
                        best[item] = {"item_id": item_id, "bm25": score, "question": share_q, "answer": share_a, "at": lo}
        return [best[i] for i in sorted(best)]

    @task("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _INDEXES:
            while len(_INDEXES) > 1:
                _INDEXES.pop(next(iter(_INDEXES)))
            postings, texts = shared.value
            _INDEXES[key] = Index(postings, threshold), {i: (item, *question_answer(text)) for i, (item, text) in texts.items()}
        index, parts = _INDEXES[key]
        for b in batches:
            found: list[list[dict]] = []
            for _, texts in texts_of(b, at):
                found += [leaks_of(t, index, parts) if t else [] for t in texts]
            if step:
                found = [x + y for x, y in zip(b.column(len(names)).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(found, leak_type)], names=[*names, "leaks"])

    return run
