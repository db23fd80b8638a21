"""Stupid-backoff scores of documents under n-gram counts of the rest of the corpus.

The score of a word after its history is the relative frequency of the longest n-gram ending there
that occurs in other documents, times ``ALPHA`` for each order given up; a word found in no other
document counts as one half occurrence. A document's own occurrences never count, else no n-gram
would be unseen.

Count tables are partitioned by the n-gram's hash. Documents are gathered into blocks of bounded text;
each block explodes its n-grams of all orders, sends the distinct ones with their counts to the
partitions of the count table, and is joined with the corpus totals that come back, in the order in
which it sent the n-grams. Longer n-grams are asked for in later rounds, and only where both their
parts were found in other documents. The sums per document are then taken inside the block. An n-gram crosses
the network once per block that has it, however frequent it is, and no table is ever broadcast.
Blocks follow the input, so that no key, however often its rows repeat, gathers in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shingles import buffers, combine, count_words, texts_of, word_hashes

ALPHA = 0.4
#: Text of a block; blocks hold several times this in hashes. N-grams are told apart by 64 bits.
BLOCK_BYTES = 8 << 20


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words' document numbers; for each order the hash of the n-gram that ends at each word (0: none); word counts."""
    words, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, run in buffers(texts):
        w, d = word_hashes(run)
        words.append(w)
        of.append(d + first)
    words, of = np.concatenate(words), np.concatenate(of)
    out = []
    for k in range(1, order + 1):
        h = np.zeros(len(words), np.uint64)
        if len(words) >= k:
            got = combine(words, k)
            got[got == 0] = 1
            h[k - 1 :] = np.where(of[k - 1 :] == of[: len(of) - k + 1], got, 0)
        out.append(h)
    return of, out, np.bincount(of, minlength=len(texts))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Partition of the count table; it rises with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers, compressed with their bytes in planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unsqueeze(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


_ZSTD = pa.Codec("zstd", compression_level=1)


def bundle(ids: list[int | None], texts: list[str | None]) -> bytes:
    """Documents of a block, compressed."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unbundle(raw: bytes) -> tuple[list[int | None], list[str | None]]:
    got = pa.ipc.open_stream(raw).read_all()
    return got.column(0).to_pylist(), got.column(1).to_pylist()


def rounds_of(order: int) -> list[list[int]]:
    """Orders that are counted together: words and pairs first, then one order after the other."""
    return [list(range(1, min(order, 2) + 1)), *([k] for k in range(3, order + 1))]


class Block:
    """The n-grams of a block's documents, and what the count tables have answered about them so far."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        self.n = len(texts)
        self.of, self.hashes, self.n_words = grams(texts, order)
        self.rest: list[np.ndarray] = []  # for each order and word: occurrences of its n-gram in other documents

    def ask(self, orders: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of these orders that other documents may have, rising, and their counts in the block.

        An n-gram of three words or more found elsewhere has both its parts found elsewhere, so only
        such n-grams are asked for; all documents that share one ask for it.
        """
        where, flat = [], []
        for k in orders:
            some = self.hashes[k - 1] != 0
            if k > 2:
                found = self.rest[k - 2] > 0
                some &= found
                some[1:] &= found[:-1]
                some[:1] = False
            where.append(np.flatnonzero(some))
            flat.append(self.hashes[k - 1][where[-1]])
        order = np.argsort(np.concatenate(flat), kind="stable")  # of equal n-grams of an order, documents rise
        flat = np.concatenate(flat)[order]
        place, of_order = np.concatenate(where)[order], np.repeat(np.arange(len(orders)), [len(w) for w in where])[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
        starts = np.flatnonzero(new)
        doc = self.of[place]
        own = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(flat)])
        n_own = np.diff(np.append(own, len(flat)))
        self.asked = place, of_order, np.cumsum(new) - 1, np.repeat(n_own, n_own)
        return flat[starts], np.diff(np.append(starts, len(flat)))

    def answer(self, orders: list[int], elsewhere: np.ndarray) -> None:
        """``elsewhere``: occurrences in other blocks of each n-gram that :meth:`ask` gave."""
        _, counts = self.ask(orders)
        assert len(elsewhere) == len(counts), "the text of a block changed between two reads"
        place, of_order, group, own = self.asked
        rest = (elsewhere + counts)[group] - own
        for i in range(len(orders)):
            n = np.zeros(len(self.of), np.int64)
            mine = of_order == i
            n[place[mine]] = rest[mine]
            self.rest.append(n)

    def scores(self, corpus: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sum of log scores of each document, and how many of its words were scored at each order (0: unknown)."""
        of, order = self.of, len(self.rest)
        log, done = np.zeros(len(of)), np.zeros(len(of), np.int64) - 1
        for k in range(order, 0, -1):
            use = (done < 0) & (self.rest[k - 1] > 0)
            if k > 1:
                base = np.zeros(len(of), np.int64)
                base[1:] = self.rest[k - 2][:-1]  # the history ends one word earlier
            else:
                base = np.maximum(1, corpus - self.n_words[of])
            log[use] = np.log(self.rest[k - 1][use] / base[use])
            done[use] = k
        unknown = done < 0
        log[unknown] = np.log(0.5 / np.maximum(1, corpus - self.n_words[of[unknown]]))
        done[unknown] = 0
        # orders given up: from the longest n-gram that fits into the document
        longest = np.minimum(np.arange(len(of)) - np.searchsorted(of, of) + 1, order)
        log += np.log(ALPHA) * (longest - np.maximum(done, 1))
        return np.bincount(of, log, self.n).astype(float), [np.bincount(of[done == k], minlength=self.n) for k in range(order + 1)]


def score_documents(docs: DataFrame, order: int = 3, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, log_score, mean_log_score, n_unknown, n_1 .. n_order``.

    Words are runs of characters other than ASCII white space, A-Z lowered. ``n_k`` counts the words
    scored by n-grams of order k. Null and empty texts have no words, score 0 and a null mean. Rows
    are documents of their own, repeated ids and texts included (a copy counts as another document);
    other columns are ignored. The input must read alike when a task is run again, as files do.
    """
    if order < 1:
        raise ValueError("order must be positive")
    names = [f"n_{k}" for k in range(1, order + 1)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for b in batches:
            for _, texts in texts_of(b, 0):
                for _, run in buffers(texts):
                    n += count_words(run)
                    size += sum(map(len, run))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["n", "size"])

    sums = rows.select("text").mapInArrow(count, "n bigint, size bigint").agg(F.sum("n"), F.sum("size")).first()
    corpus, blocks = sums[0] or 0, max(1, ceil((sums[1] or 0) / block_bytes))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: tuple[list, list] = ([], [])

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([bundle(*held)], pa.large_binary()).cast(pa.binary())], names=["block", "data"])

        for b in batches:
            for at, texts in texts_of(b, 1, 64):
                for doc, text in zip(b.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    held[0].append(doc)
                    held[1].append(text)
                    size += len(text or "") + 16
                    if size >= block_bytes:
                        yield block()
                        held, size, number = ([], []), 0, number + 1
        if held[0]:
            yield block()

    dealt = rows.mapInArrow(gather, "block bigint, data binary").repartition(blocks, "block")

    rounds = rounds_of(order)

    def read(left: pa.Table, right: pa.Table | None, answered: int) -> tuple[list[int | None], Block]:
        ids, texts = unbundle(left.column("data")[0].as_buffer().to_pybytes())
        block = Block(texts, order)
        for k in range(answered):
            got = sorted((b, t) for r, b, t in zip(right.column("round").to_pylist(), right.column("bucket").to_pylist(), right.column("elsewhere").to_pylist(), strict=True) if r == k)
            block.answer(rounds[k], np.concatenate([np.zeros(0, np.uint64), *(unsqueeze(t) for _, t in got)]).astype(np.int64))
        return ids, block

    def explode(block: Block, number: int, k: int) -> pa.Table:
        distinct, n = block.ask(rounds[k])
        buckets, cut = np.unique(bucket_of(distinct, blocks), return_index=True)
        ends = np.append(cut, len(distinct))[1:]
        out = [(b, number, squeeze(np.diff(distinct[x:y], prepend=np.uint64(0))), squeeze(n[x:y])) for b, x, y in zip(buckets.tolist(), cut.tolist(), ends.tolist(), strict=True)]
        return pa.table([pa.array([o[c] for o in out], ty) for c, ty in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "block", "grams", "counts"])

    def total(t: pa.Table) -> pa.Table:
        parts = [np.cumsum(unsqueeze(g), dtype=np.uint64) for g in t.column("grams").to_pylist()]
        counts = [unsqueeze(c).astype(np.int64) for c in t.column("counts").to_pylist()]
        flat, own = np.concatenate(parts), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")  # sorted runs laid end to end
        starts = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
        sums = np.add.reduceat(own[order], starts)
        rest = np.empty(len(flat), np.int64)
        rest[order] = np.repeat(sums, np.diff(np.append(starts, len(flat)))) - own[order]
        cut = np.cumsum([0, *map(len, parts)])
        answers = [squeeze(rest[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.table([t.column("block").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(answers, pa.binary())], names=["block", "bucket", "elsewhere"])

    def first(t: pa.Table) -> pa.Table:
        return explode(read(t, None, 0)[1], t.column("block")[0].as_py(), 0)

    def later(k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return explode(read(left, right, k)[1], left.column("block")[0].as_py(), k)

        return run

    asked, answers = "bucket bigint, block bigint, grams binary, counts binary", None
    for k in range(len(rounds)):
        if answers is None:
            sent = dealt.groupBy("block").applyInArrow(first, asked)
        else:
            sent = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later(k), asked)
        back = sent.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(total, "block bigint, bucket bigint, elsewhere binary").withColumn("round", F.lit(k))
        back = back.repartition(blocks, "block")
        answers = back if answers is None else answers.unionByName(back)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, block = read(left, right, len(rounds))
        log, by = block.scores(corpus)
        mean = [x / n if n else None for x, n in zip(log.tolist(), block.n_words.tolist(), strict=True)]
        return pa.table([pa.array(ids, pa.int64()), pa.array(block.n_words.astype(np.int64)), pa.array(log), pa.array(mean, pa.float64()), *(pa.array(b.astype(np.int64)) for b in by)], names=["doc_id", "n_words", "log_score", "mean_log_score", "n_unknown", *names])

    schema = "doc_id bigint, n_words bigint, log_score double, mean_log_score double, n_unknown bigint, " + ", ".join(f"{n} bigint" for n in names)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def oracle(table: str = "documents") -> str:
    """The same for order 3 in DuckDB, rounded; ids must be unique."""
    return rf"""
    WITH w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM
               (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM {table})),
    g AS (SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT count(*) AS n FROM w),
    c1 AS (SELECT w, count(*) AS n FROM g GROUP BY ALL), c2 AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY ALL),
    c3 AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY ALL),
    o1 AS (SELECT doc_id, w, count(*) AS n FROM g GROUP BY ALL), o2 AS (SELECT doc_id, v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY ALL),
    o3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY ALL),
    r1 AS (SELECT doc_id, w, c1.n - o1.n AS n FROM o1 JOIN c1 USING (w)), r2 AS (SELECT doc_id, v, w, c2.n - o2.n AS n FROM o2 JOIN c2 USING (v, w)),
    r3 AS (SELECT doc_id, u, v, w, c3.n - o3.n AS n FROM o3 JOIN c3 USING (u, v, w)),
    x AS (SELECT g.doc_id, g.i, r1.n AS a, coalesce(r2.n, 0) AS b, coalesce(r3.n, 0) AS c, h1.n AS ha, h2.n AS hb, greatest(1, t.n - d.n) AS rest
          FROM g JOIN d USING (doc_id) CROSS JOIN t JOIN r1 ON r1.doc_id = g.doc_id AND r1.w = g.w
          LEFT JOIN r2 ON r2.doc_id = g.doc_id AND r2.v = g.v AND r2.w = g.w LEFT JOIN r3 ON r3.doc_id = g.doc_id AND r3.u = g.u AND r3.v = g.v AND r3.w = g.w
          LEFT JOIN r1 h1 ON h1.doc_id = g.doc_id AND h1.w = g.v LEFT JOIN r2 h2 ON h2.doc_id = g.doc_id AND h2.v = g.u AND h2.w = g.v),
    s AS (SELECT doc_id, CASE WHEN c > 0 THEN 3 WHEN b > 0 THEN 2 WHEN a > 0 THEN 1 ELSE 0 END AS k, least(i, 3) AS longest,
          CASE WHEN c > 0 THEN ln(c / hb) WHEN b > 0 THEN ln(b / ha) WHEN a > 0 THEN ln(a / rest) ELSE ln(0.5::DOUBLE / rest) END AS l FROM x)
    SELECT doc_id, coalesce(any_value(d.n), 0)::BIGINT AS n_words, round(coalesce(sum(l + ln({ALPHA}::DOUBLE) * (longest - greatest(k, 1))), 0), 3)::DOUBLE AS log_score,
           round(sum(l + ln({ALPHA}::DOUBLE) * (longest - greatest(k, 1))) / any_value(d.n), 6)::DOUBLE AS mean_log_score,
           count(*) FILTER (k = 0)::BIGINT AS n_unknown, count(*) FILTER (k = 1)::BIGINT AS n_1, count(*) FILTER (k = 2)::BIGINT AS n_2, count(*) FILTER (k = 3)::BIGINT AS n_3
    FROM (SELECT doc_id FROM {table}) q LEFT JOIN s USING (doc_id) LEFT JOIN d USING (doc_id) GROUP BY doc_id"""
