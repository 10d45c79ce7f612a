"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Every ordered triple of words that stands within four words of a benchmark item is a possible
seed, so a copy keeps seeds wherever three of four words survive: a copy that reaches the bound
by replaced words has L / 3 - 2 of them or more (see needed). One pass over the whole corpus finds
the blocks of documents that have such triples: a bit field of fixed size rules out most others,
an exact join the rest. All seeds count, however many documents have them; of an item's seeds
that other items have too, the commonest are left out as long as any copy must have enough of
those that stay. Documents and items that share L / 6 - 1 seeds (one at least) are candidates. A candidate or a stretch of it with too few of the item's words for the bound is
passed over, as each point of the score needs them. Around the blocks with shared seeds the
words are aligned locally (match 2, mismatch -1, gap -1); the score divided by the item's best
possible score tells a copy, edited or not, from chance.

Null texts count as empty. Items under three words are found only in documents that consist of
these words; items without words in none. There is one row for each pair of a document id and
an item id that match, however often their rows repeat; of an id's several texts the best score
counts. Null ids give no rows, and such documents stay in clean(). Empty tables give no rows.
Columns besides ids and texts don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import checkpointed, having_ids, map_batches
from prosegauge.llm.near_dedup import mixed, shingles, word_hashes

#: Places of a seed's words within a window.
SEED_PLACES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Words of a document whose seeds are told apart by place only as one block.
BLOCK = 64
#: Bits of the field that rules out sequences no item has: 8 MB whatever the benchmark.
FIELD_BITS = 26
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1


def seeds_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the text's seeds; texts under three words are one seed."""
    w = word_hashes(text or "")
    if len(w) < 3:
        return shingles(text, 3).view(np.int64), np.zeros(min(1, len(w)), np.int64)
    found, places = [], []
    for i, j, k in SEED_PLACES:
        n = max(0, len(w) - k)
        h = mixed(w[i : i + n])
        h = mixed(h + w[j : j + n] * np.uint64(3))
        found.append(mixed(h + w[k : k + n] * np.uint64(5)))
        places.append(np.arange(n))
    return np.concatenate(found).view(np.int64), np.concatenate(places)


def needed(words):
    """How many different seeds of an item of that many words a candidate shares; a number or a Column.

    A copy with m of L words matched and e replaced, added or missing between them has m - 2 - e
    seeds at least, as a triple of matches is lost only if two errors stand inside it. With
    2 m - e >= L and at most L words matched or replaced that is L / 3 - 2 or more (with words
    added instead, as long as e <= m - L / 3).
    """
    return words / 3 - 2


def seeds(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, words, seed): the different seeds of each item and its number of words, less if its seeds repeat."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [np.unique(seeds_of(t)[0]) for t in batch.column(1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            words = pa.array([min(len(word_hashes(t or "")), len(f) // len(SEED_PLACES) + 3) for t, f in zip(batch.column(1).to_pylist(), found, strict=True)], pa.int32())
            return {"item": batch.column(0).take(row), "words": words.take(row), "seed": pa.array(np.concatenate([*found, np.zeros(0, np.int64)]), pa.int64())}

        return work

    rows = benchmark.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    return map_batches(rows, make, "item long, words int, seed long").distinct()


def _field(wanted: DataFrame) -> np.ndarray:
    """A bit for each hashed seed; the words of the field are made and joined in Spark, at most 2^FIELD_BITS / 64 rows."""
    bit = F.shiftrightunsigned("seed", 64 - FIELD_BITS)
    words = wanted.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << FIELD_BITS - 6, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, seed, block): seeds whose bit is set and the blocks that have them, over all documents."""
    field = docs.sparkSession.sparkContext.broadcast(_field(wanted))

    def make():
        bits = field.value

        def work(batch: pa.RecordBatch) -> dict:
            ids, found, blocks = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = seeds_of(text)
                b = h.view(np.uint64) >> np.uint64(64 - FIELD_BITS)
                some = np.flatnonzero(bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1))
                if len(some):
                    h, block = h[some], at[some] // BLOCK
                    _, first = np.unique(mixed(h.view(np.uint64)) + mixed(block.astype(np.uint64)), return_index=True)
                    ids.append(np.full(len(first), doc, np.int64))
                    found.append(h[first])
                    blocks.append(block[first])
            empty = np.zeros(0, np.int64)
            return {"doc": pa.array(np.concatenate([*ids, empty])), "seed": pa.array(np.concatenate([*found, empty])), "block": pa.array(np.concatenate([*blocks, empty]), pa.int32())}

        return work

    return map_batches(docs, make, "doc long, seed long, block int")


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word hashes: (score, start, end) in b.

    Row by row; a gap in b runs along the row and is a cumulative maximum.
    """
    n = len(b)
    best, steps = (0, 0, 0), GAP * np.arange(n + 1)
    above, begun = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for x in a:
        score = np.zeros(n + 1, np.int64)
        since = np.arange(n + 1)
        diagonal = above[:-1] + np.where(b == x, MATCH, MISMATCH)
        down = above[1:] + GAP
        score[1:] = np.maximum(0, np.maximum(diagonal, down))
        since[1:] = np.where(score[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= down, begun[:-1], begun[1:]))
        level = score - steps
        reach = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == reach, np.arange(n + 1), 0))
        run = reach + steps
        along = run > score
        score, since = np.where(along, run, score), np.where(along, since[source], since)
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(since[k]), k)
        above, begun = score, since
    return best


def stretches(blocks: list[int], size: int) -> list[tuple[int, int]]:
    """Word ranges of the document that could hold an item of that size, from the blocks with shared seeds; overlapping ranges are joined."""
    margin = size + size // 2 + 4
    out: list[list[int]] = []
    for b in sorted(blocks):
        lo, hi = max(0, b * BLOCK - margin), (b + 1) * BLOCK + 3 + margin
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _may_hold(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether b has so many words of a that an alignment can reach the bound."""
    return bool(np.isin(a, b).sum() >= least * len(a))


def matches(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(id, item, score, start_word, end_word): documents that hold an item; start and end are word places."""
    corpus = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    items = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("item_text"))
    every = checkpointed(seeds(benchmark, item_column, item_text))
    wanted = every.select("seed").distinct()
    hits = checkpointed(_hits(corpus, wanted).join(wanted, "seed", "left_semi"))
    places = (F.collect_set("seed").alias("seen"), F.collect_set("block").alias("blocks"))
    shared = hits.join(every.select("seed", "item", "words").distinct(), "seed").groupBy("doc", "item").agg(F.min("words").alias("words"), *places)
    shared = checkpointed(shared.where(F.size("seen") >= F.floor(needed(F.col("words")))).select("doc", "item", "blocks"))
    held = having_ids(corpus, shared.select("doc").distinct(), "doc").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc", "h"])
    pairs = shared.join(items.dropDuplicates(), "item").join(held, "doc").select("doc", "item", "blocks", "item_text", "text")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(5))
            for doc, item, blocks, wanted_text, text in zip(*columns, strict=True):
                a, b = word_hashes(wanted_text or ""), word_hashes(text or "")
                found = (0, 0, 0)
                for lo, hi in stretches(blocks, len(a)) if _may_hold(a, b, least) else ():
                    if not _may_hold(a, b[lo:hi], least):
                        continue
                    score, start, end = align(a, b[lo:hi])
                    if score > found[0]:
                        found = (score, lo + start, lo + end)
                share = found[0] / (MATCH * len(a)) if len(a) else 0.0
                if share >= least:
                    out.append((doc, item, share, found[1], found[2]))
            rows = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            return {n: pa.array(r, k) for n, r, k in zip((id_column, item_column, "score", "start_word", "end_word"), rows, kinds, strict=True)}

        return work

    found = map_batches(pairs, make, f"{id_column} long, {item_column} long, score double, start_word int, end_word int")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word")).alias("m")
    return found.groupBy(id_column, item_column).agg(best).select(id_column, item_column, "m.score", (-F.col("m.s")).alias("start_word"), "m.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents that hold no item; null ids stay."""
    bad = matches(docs, benchmark, id_column, text_column, **options).select(id_column).distinct()
    return docs.join(bad, id_column, "left_anti")
