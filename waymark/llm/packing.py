"""Best-fit sequence packing from length patterns fitted by non-negative least squares.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` rows however
large the corpus is; documents themselves never leave the executors. Patterns of few documents
(multisets of length bins that fill a sequence) get repeat counts by NNLS against the histogram; the
counts are rounded down, and what is left is packed best-fit in decreasing length, into the gaps of
the patterns first.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.shingles import task, worker_cache
from waymark.plans.storage import save

#: Words cached per worker before the cache starts anew, and texts encoded at once.
CACHE_WORDS, TEXTS_AT_ONCE = 700_000, 500


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Lawson-Hanson active-set solution of min ||a x - h|| with x >= 0."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(rounds):
        grad = a.T @ (h - a @ x)
        grad[free] = -np.inf
        j = int(np.argmax(grad))
        if grad[j] <= tol:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], h, rcond=None)[0]
            if s[free].min() > 0:
                x = s
                break
            bad = free & (s <= 0)
            alpha = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + alpha * (s - x)
            free &= x > tol * 1e-3
            x[~free] = 0
            if not free.any():
                break
    return x


def patterns(bins: int, parts: int, least: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``parts`` bins, each ``least`` or more, whose upper edges fill a sequence."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, got: tuple[int, ...]) -> None:
        if left == 0:
            out.append(got)
        elif len(got) < parts:
            for b in range(min(left, top), least - 1, -1):
                grow(left - b, b, (*got, b))

    grow(bins, bins, ())
    return out


def plan_histogram(hist: dict[int, int], capacity: int, bins: int = 64, parts: int = 3) -> tuple[dict[int, list[tuple]], int]:
    """Placement of all pieces of a length histogram.

    Returns, for each length, runs ``(first_rank, n, sequence, offset, per)``: the pieces of that
    length ranked ``first_rank ..`` go ``per`` to a sequence, from ``sequence`` on, at ``offset``;
    and the number of sequences. Work and result depend on the number of distinct lengths only.
    """
    left, taken = dict(hist), defaultdict(int)
    runs: dict[int, list[tuple]] = defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, sequences)
    mask, sequences, stock = 0, 0, sum(1 << x for x in hist if hist[x])

    def put(length: int, n: int, seq: int, offset: int, per: int) -> None:
        nonlocal stock
        runs[length].append((taken[length], n, seq, offset, per))
        taken[length] += n
        left[length] -= n
        if not left[length]:
            stock &= ~(1 << length)

    def gap(free: int, seq: int, n: int) -> None:
        nonlocal mask
        if free and n:
            gaps[free].append((seq, n))
            mask |= 1 << free

    width = -(-capacity // bins)
    queue: dict[int, list[int]] = defaultdict(list)
    for length in sorted(hist):
        queue[-(-length // width)].append(length)
    h = np.array([sum(hist[x] for x in queue.get(b, ())) for b in range(bins + 1)], float)
    shapes = [p for p in patterns(bins, parts, max(1, bins // 16)) if all(h[b] for b in p)]
    if shapes:
        a = np.zeros((bins + 1, len(shapes)))
        for j, p in enumerate(shapes):
            np.add.at(a[:, j], list(p), 1)
        rows = a.any(axis=1)
        fit = np.floor(nnls(a[rows], h[rows]) + 1e-9).astype(np.int64)
        for j in np.argsort(-fit, kind="stable"):
            p, times = shapes[j], int(fit[j])
            while times > 0:
                pick, need, room = [], defaultdict(int), capacity
                for i, b in enumerate(p):  # the longest lengths of each bin first
                    while queue[b] and left[queue[b][-1]] == 0:
                        queue[b].pop()
                    if i + 1 == len(p) > 1:  # the last place takes the longest piece that still fits
                        at, open_ = None, stock & ((1 << (room + 1)) - 1)
                        while open_:
                            x = open_.bit_length() - 1
                            if left[x] > need.get(x, 0):
                                at = x
                                break
                            open_ &= ~(1 << x)
                    else:
                        at = next((x for x in reversed(queue[b]) if left[x] > need.get(x, 0)), None)
                    if at is None:
                        break
                    pick.append(at)
                    need[at] += 1
                    room -= at
                if len(pick) < len(p) or room < 0:
                    break
                n = min(times, *(left[x] // k for x, k in need.items()))
                offset = 0
                for x in pick:
                    put(x, n, sequences, offset, 1)
                    offset += x
                gap(capacity - offset, sequences, n)
                sequences += n
                times -= n
    for length in sorted(left, reverse=True):
        while left[length]:
            fits = mask >> length
            if fits:
                free = length + (fits & -fits).bit_length() - 1
                seq, n = gaps[free].pop()
                if not gaps[free]:
                    mask &= ~(1 << free)
            else:
                free, seq, n = capacity, sequences, -(-left[length] // (capacity // length))
                sequences += n
            per = free // length
            full = min(n, left[length] // per)
            if full:
                put(length, full * per, seq, capacity - free, per)
                gap(free - per * length, seq, full)
            rest = left[length]
            if full < n and 0 < rest < per:
                put(length, rest, seq + full, capacity - free, rest)
                gap(free - rest * length, seq + full, 1)
                full += 1
            gap(free, seq + full, n - full)
    return runs, sequences


class WordEncoder:
    """Token ids of whole texts, encoding each distinct word once.

    Words are cut at ASCII white space, and a full stop or comma that ends a word stands alone.
    That changes no id for tokenizers that lower the case, drop white space, never join across it or
    between letters and marks, and end a word's last token with ``</w>``. Texts that could hold a
    special token (any ``<|``) go through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for w, i in self.tok.get_vocab().items():
            self.ends[i] = w.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at = np.zeros(1 << 16, np.int64)  # where the ids of word k start; those of k + 1 end them

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha()]
        ids = np.array(self._whole(" ".join(plain)), np.uint32)
        size = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
        if len(size) != len(plain):
            plain, ids, size = [], ids[:0], size[:0]
        done = set(plain)
        rest = [w for w in new if w not in done]
        more, lengths = self._each(rest)
        ids, size = np.concatenate([ids, more]), np.concatenate([size, lengths])
        k, n = len(self.known), len(new)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < k + n + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.at[k + 1 : k + n + 1] = self.used + np.cumsum(size)
        self.used += len(ids)
        self.known.update(zip(plain + rest, range(k, k + n), strict=True))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these words and how many each has, told apart by where their tokens stand in one text."""
        got = self.tok.encode(" ".join(words), add_special_tokens=False)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size + 1) - 1
        place = np.array(got.offsets, np.int64).reshape(-1, 2)
        of = np.searchsorted(end, place[:, 0], "right")
        inside = not len(of) or (of[-1] < len(words) and (np.diff(of) >= 0).all() and (place[:, 1] <= end[of]).all() and (place[:, 0] >= (end - size)[of]).all())
        if inside:
            return np.array(got.ids, np.uint32), np.bincount(of, minlength=len(words))
        each = [self._whole(w) for w in words]
        return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a batch; a null text has none."""
        texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # a copy: case folding misreads slices
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain), r"([a-z])([.,])(\s|$)", r"\1 \2\3"))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.clear()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        get = self.known
        word = np.array([get[w] for w in distinct], np.int64)[words.indices.to_numpy()] if distinct else np.zeros(0, np.int64)
        start = self.at[word]
        size = self.at[word + 1] - start
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [np.array(self._whole(texts[i].as_py()), np.uint32) if special[i] else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


_ENCODERS: dict[str, WordEncoder] = worker_cache("packing")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, slot bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenise whole texts and cut those over ``capacity`` tokens; ``slot`` counts a task's pieces of a length."""

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    @task("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer))
        part, slots, end = TaskContext.get().partitionId(), defaultdict(int), np.array(end_id, "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                out: list[list] = [[] for _ in range(7)]
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                    raw = ids.astype("<u4").tobytes() + end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        got = raw[start : start + 4 * capacity]
                        n = len(got) // 4
                        for col, v in zip(out, (doc, piece, start // 4, n, zlib.crc32(got), part, slots[n]), strict=True):
                            col.append(v)
                        slots[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens, one row per piece.

    A null or empty text is the end id alone. Repeated rows and ids are packed as often as they
    occur; a null id stays null; other columns are ignored whatever their names. An empty table
    gives an empty result. Ranks of equal lengths come from per-task counts, so no length, however
    common, is gathered anywhere.
    """
    pieces = save(cut_pieces(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_histogram(hist, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}

    @task("packing")
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("slot").to_numpy() + b.column("base").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                first, _, s, o, per = table[int(length[rows[0]])]
                at = np.searchsorted(first, rank[rows], "right") - 1
                k = rank[rows] - first[at]
                seq[rows], offset[rows] = s[at] + k // per[at], o[at] + k % per[at] * length[rows]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return pieces.join(base, ["part", "length"]).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
