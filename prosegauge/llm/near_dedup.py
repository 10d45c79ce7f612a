"""MinHash near-dedup with DartMinHash signatures.

A text is a weighted set of its five-word shingles (lower case, letters and digits); a shingle
that occurs c times weighs 1 + ln c. Each element owns an endless field of random darts over
(weight, rank): a unit strip of weight receives darts at unit rate along the rank axis, heavier
strips [1,2), [2,4), [4,8) ... at rates 1, 2, 4. A set catches the darts below its weights;
hashing deals them to K coordinates, and each coordinate keeps its earliest dart. Looking at
ranks up to K (ln K + 5) / total weight catches about K (ln K + 5) darts whatever the set's
size; the few sets with an empty coordinate look twice as far again. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity (the plain one where no
shingle repeats).

Signatures are cut into bands; texts that share a band are candidates. Equal sets are one
item from the start. In each band's group a leader is compared with the others, exactly, on
the shingles themselves; the leader is the item that shares most with others, so that the
original of many edited copies meets them all. Verified links make components. Items of
groups that still hold several components are then joined on their rarest shingles: of sets
with a similarity of t, each has at most 1 - t of its weight in shingles that the other lacks,
so that one of the first 1 - t of its weight in any common order meets the other's. Two sets of
weights v and w can only be similar if what follows the first common shingle, this included,
weighs t / (1 + t) (v + w) in both. Keys therefore hold a shingle and the classes of both
weights, each set only gives the keys that this bound allows, and the join tests it exactly.
Copies with many edits of their own have these first, so they meet no other copy at all. That
step loses nothing. The common order is by how many of these texts have a shingle; those that one
alone has come first and are only counted by their weight.

What can be lost: a link whose ends share no band (probability (1 - 0.8^6)^42 < 3e-6 at 0.8).

Null counts as empty. Texts under five words are one shingle; texts without words are
duplicates only of equal texts. Repeated rows share a class; an id with several texts is one
document, whose class holds the near-duplicates of each. Rows with a null id have a null class
and are never left out. The class id is the least id of the class. Columns besides id and text
don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegauge.llm.common import checkpointed, having_ids, map_batches

WORDS, LEAST = 5, 0.8
ROWS, BANDS = 6, 42
COORDINATES = ROWS * BANDS
_U = np.uint64
_STEP, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE, _INVERSE = _U(0x100000001B3), _U(pow(0x100000001B3, -1, 1 << 64))
_TABLES: dict = {}
#: Ratio between the classes of set weights that the exact join tells apart.
CLASS_RATIO = 1.05


def mixed(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit numbers (finaliser of a split-mix generator)."""
    x = x + _STEP
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _times(number: np.uint64, n: int) -> np.uint64:
    return _U(int(number) * n & 0xFFFFFFFFFFFFFFFF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        ones = np.ones(size, _U)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = _BASE, _INVERSE
        have = _TABLES["powers"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have


def _word_letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def word_hashes(text: str, with_places: bool = False):
    """One 64-bit hash for each word (maximal run of letters and digits, lower case)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letters = _word_letters()
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = letters[code]
    edge = np.diff(inside)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, _U)
    np.cumsum((code.astype(_U) + _U(1)) * up[: len(code)], out=sums[1:])
    hashes = mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(_U))
    return (hashes, lo, hi) if with_places else hashes


def shingles(text: str | None, words: int = WORDS, distinct: bool = True) -> np.ndarray:
    """Hashes of the text's word shingles, sorted and distinct unless told otherwise."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    h = np.full(n, len(w) if len(w) < words else words, _U)
    for k in range(min(words, len(w))):
        h = mixed(h + w[k : k + n] * _U(2 * k + 1))
    return np.unique(h) if distinct else h


def weighted_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct shingles, sorted, and their weights."""
    found, times = np.unique(shingles(text, distinct=False), return_counts=True)
    return found, 1.0 + np.log(times)


def similar(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], least: float = LEAST) -> bool:
    """Whether two weighted sets have at least that Jaccard similarity."""
    _, i, j = np.intersect1d(p[0], q[0], assume_unique=True, return_indices=True)
    both = np.minimum(p[1][i], q[1][j]).sum()
    return bool(both >= least * (p[1].sum() + q[1].sum() - both) - 1e-9)


def _darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, reach: np.ndarray):
    """(owner, rank, dart) of all darts that the weighted elements catch within their owner's reach."""
    lo, hi, strip = 0.0, 1.0, 0
    while len(element):
        seed = mixed(element ^ _times(_B, strip))
        live, rank, level = np.arange(len(element)), np.zeros(len(element)), 0
        while len(live):
            h = mixed(seed[live] + _times(_A, level))
            rank = rank - np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (hi - lo)
            near = rank <= reach[owner[live]]
            live, rank, h = live[near], rank[near], h[near]
            dart = mixed(h)
            if strip or (weight[live] < hi).any():
                at = lo + (hi - lo) * ((mixed(dart) >> _U(11)).astype(np.float64) * 2.0**-53)
                caught = at < weight[live]
                yield owner[live[caught]], rank[caught], dart[caught]
            else:
                yield owner[live], rank, dart
            level += 1
        heavy = weight > hi
        element, weight, owner = element[heavy], weight[heavy], owner[heavy]
        lo, hi, strip = hi, 2 * hi, strip + 1


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = COORDINATES) -> np.ndarray:
    """(len(sets), k) 32-bit coordinates of the weighted sets (weights 1 if none are given)."""
    out = np.full((len(sets), k), 0xFFFFFFFFFFFFFFFF, _U)
    sizes = np.array([float(len(s)) if weights is None else float(weights[i].sum()) for i, s in enumerate(sets)])
    todo, more = np.flatnonzero(sizes > 0), 1.0
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        weight = np.ones(len(element)) if weights is None else np.concatenate([weights[i] for i in todo]).astype(float)
        best = np.full(len(todo) * k, 0xFFFFFFFFFFFFFFFF, _U)
        for who, rank, dart in _darts(element, weight, owner, more * k * (math.log(k) + 5) / sizes[todo]):
            early = rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32) | dart >> _U(32)
            np.minimum.at(best, who * k + (dart & _U(0xFFFFFFFF)).astype(np.int64) % k, early)
        out[todo] = best.reshape(len(todo), k)
        todo, more = todo[(out[todo] == _U(0xFFFFFFFFFFFFFFFF)).any(axis=1)], 2 * more
    return (out & _U(0xFFFFFFFF)).astype(np.uint32)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows).astype(_U)
    key = np.broadcast_to(np.arange(k // rows, dtype=_U), (n, k // rows)).copy()
    for j in range(rows):
        key = mixed(key * _BASE + parts[:, :, j])
    return key.view(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """(id, set, w, bands): digest and weight of each text's shingle set, keys of its bands."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            both = [weighted_shingles(t) for t in texts]
            sets, weights = [s for s, _ in both], [w for _, w in both]
            digest = [hashlib.md5(s.tobytes() if len(s) else b"text" + t.encode("utf-8", "replace")).digest() for s, t in zip(sets, texts, strict=True)]
            keys = band_keys(signatures(sets, weights))
            return {
                "id": batch.column(0),
                "set": pa.array(digest, pa.binary()),
                "w": pa.array([w.sum() for w in weights], pa.float64()),
                "bands": pa.array([k if len(s) else k[:0] for s, k in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
            }

        return work

    return map_batches(docs, make, "id long, set binary, w double, bands array<bigint>")


def rare_keys(shingle: np.ndarray, weight: np.ndarray, often: np.ndarray, total: float, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weight from there on) of a set's first shingles in the order of that frequency.

    Given are the shingles that other sets have too, and the weight of the whole set; the rest of
    it comes first in the order. A key names a shingle, the class of the set's own weight and that
    of a partner's; it is given if a partner of that class can have its first common shingle there.
    """
    order = np.lexsort((shingle, often))
    shingle, weight = shingle[order], weight[order]
    rest = np.cumsum(weight[::-1])[::-1]
    step, bound = math.log(CLASS_RATIO), least / (1 + least)
    # a little more than the bound allows, so that rounding can't leave out a key
    most = np.minimum(rest / bound - total, total / least) * (1 + 1e-9)
    low = math.floor(math.log(least * total * (1 - 1e-9)) / step)
    high = np.where(most >= least * total * (1 - 2e-9), np.floor(np.log(np.maximum(most, 1e-9)) / step), low - 1).astype(np.int64)
    some = np.flatnonzero(high >= low)
    times = high[some] - low + 1
    at = np.repeat(some, times)
    partner = low + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    # weights beside a class border count for both classes
    classes = {math.floor(math.log(total * x) / step) for x in (1, 1 + 1e-9, 1 - 1e-9)}
    keys = [mixed(mixed(shingle[at] + np.minimum(partner, c).astype(_U)) + np.maximum(partner, c).astype(_U)) for c in sorted(classes)]
    return np.concatenate(keys), np.tile(rest[at], len(classes))


def _shared_shingles(texts: DataFrame) -> DataFrame:
    """(item, component, t, w, often, shingle, weight): the shingles that several of these texts have, and how many have them."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = [weighted_shingles(t) for t in batch.column(3).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(s) for s, _ in found]))
            own = {n: batch.column(i).take(row) for i, n in enumerate(("item", "component", "t"))}
            flat = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, kind)]))
            return own | {"w": pa.array([w.sum() for _, w in found], pa.float64()).take(row), "shingle": flat([s.view(np.int64) for s, _ in found], np.int64), "weight": flat([w for _, w in found], np.float64)}

        return work

    rows = texts.select("id", "component", F.xxhash64("text").alias("t"), "text")
    every = map_batches(rows, make, "item long, component long, t long, w double, shingle long, weight double")
    return every.withColumn("often", F.count("*").over(Window.partitionBy("shingle"))).where("often > 1")


def _rare(texts: DataFrame, least: float) -> DataFrame:
    """(item, component, key, w, rest): the keys of each text's first shingles (see rare_keys)."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            key, rest, times = [np.zeros(0, _U)], [np.zeros(0)], []
            for total, found in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = found.values
                k, r = rare_keys(own.field(1).to_numpy().view(_U), own.field(2).to_numpy(), own.field(0).to_numpy(), total, least)
                key.append(k)
                rest.append(r)
                times.append(len(k))
            row = pa.array(np.repeat(np.arange(len(times)), times))
            own = {n: batch.column(i).take(row) for i, n in enumerate(("item", "component", "w"))}
            return own | {"key": pa.array(np.concatenate(key).view(np.int64)), "rest": pa.array(np.concatenate(rest))}

        return work

    sets = _shared_shingles(texts).groupBy("item", "component", "t", "w").agg(F.collect_list(F.struct("often", "shingle", "weight")).alias("s"))
    return map_batches(sets.select("item", "component", "w", "s"), make, "item long, component long, key long, w double, rest double")


def _across(rows: DataFrame) -> DataFrame:
    """The rows whose key several components have, and whether each is outside the component that has it most.

    Of two items in different components one at least is outside, so that those are joined with
    all: a large component beside a few others makes no square.
    """
    key = Window.partitionBy("key")
    counted = rows.repartition("key").withColumn("n", F.count("*").over(Window.partitionBy("key", "component")))
    ranked = counted.withColumn("most", F.max(F.struct("n", "component")).over(key)).withColumn("minor", F.col("component") != F.col("most.component"))
    return ranked.withColumn("some", F.max("minor").over(key)).where("some").drop("n", "most", "some")


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of which a text of each has at least that similarity to one of the other."""

    def make():
        kept: dict = {}

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            if text not in kept:
                if len(kept) >= 500:
                    kept.clear()
                kept[text] = weighted_shingles(text)
            return kept[text]

        def work(batch: pa.RecordBatch) -> dict:
            ok = [similar(of(x), of(y), least) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

        return work

    both = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return map_batches(both, make, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches, by passing labels on and jumping ahead."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        label = checkpointed(label)
        heard = (
            both.join(label.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("said"))
        )
        near = label.join(heard, "id").select("id", F.least("component", "said").alias("next"), "component")
        jump = label.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = checkpointed(near.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"), F.col("component").alias("was")))
        still = moved.where("component <> was").limit(1).count()
        label = moved.select("id", "component")
        if not still:
            return label


def _of_one_id(members: DataFrame) -> DataFrame:
    """(a, b): items of different texts that have the same id."""
    ends = members.groupBy("id").agg(F.min("item").alias("a"), F.max("item").alias("z")).where("a <> z")
    return ends.join(members, "id").where("item <> a").select("a", F.col("item").alias("b")).distinct()


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """(id, class_id) for each row: class_id is the least id of the near-duplicates' component."""
    every = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    whole = every.where(F.col("id").isNotNull())
    sketched = checkpointed(_sketched(whole))
    items = checkpointed(sketched.groupBy("set").agg(F.min(F.struct("id", "w", "bands")).alias("m")).select("set", F.col("m.id").alias("item"), "m.w", "m.bands"))
    members = sketched.select("id", "set").join(items.select("set", "item"), "set").select("id", "item")
    linked = _of_one_id(members)
    rows = items.select("item", "w", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    grouped = checkpointed(rows.join(shared, "key"))
    found = having_ids(whole, grouped.select(F.col("item").alias("id")).distinct(), "id")
    texts = checkpointed(found.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"]).drop("h"))
    fair = (F.col("w") >= least * F.col("w_a") - 1e-6) & (F.col("w_a") >= least * F.col("w") - 1e-6)
    ends = (F.least("a", "item").alias("a"), F.greatest("a", "item").alias("b"))
    # how much each item shares: the sizes of its groups
    sizes = grouped.groupBy("key").count()
    weight = grouped.join(sizes, "key").groupBy("item").agg(F.sum("count").alias("weight"))
    order = F.struct("weight", F.xxhash64("item"))
    leaders = grouped.join(weight, "item").groupBy("key").agg(F.max_by("item", order).alias("a"), F.max_by("w", order).alias("w_a"))
    tested = checkpointed(grouped.join(leaders, "key").where((F.col("item") != F.col("a")) & fair).select(*ends).distinct())
    linked = checkpointed(linked.union(_similar(tested, texts, least)))
    label = components(linked) if linked.limit(1).count() else None
    known = grouped.withColumn("component", F.col("item"))
    if label is not None:
        known = grouped.join(label.withColumnRenamed("id", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    known = checkpointed(known.select("item", "key", "component"))
    split = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    still = checkpointed(known.join(split, "key").select("item", "component").distinct())
    if still.limit(1).count():
        left = checkpointed(having_ids(texts, still.select(F.col("item").alias("id")), "id").join(still.withColumnRenamed("item", "id"), "id"))
        rows = checkpointed(_across(_rare(left, least)))
        others = rows.select("key", F.col("item").alias("a"), F.col("w").alias("w_a"), F.col("rest").alias("rest_a"), F.col("component").alias("component_a"), F.col("minor").alias("minor_a"))
        can = F.least("rest", "rest_a") >= least / (1 + least) * (F.col("w") + F.col("w_a")) - 1e-6
        once = F.col("component") != F.col("component_a"), ~F.col("minor_a") | (F.col("item") < F.col("a"))
        more = rows.where("minor").join(others, "key").where(once[0] & once[1] & can)
        more = checkpointed(more.select(*ends).distinct().join(tested, ["a", "b"], "left_anti"))
        fresh = checkpointed(_similar(more, left, least))
        if fresh.limit(1).count():
            label = components(linked.union(fresh))
    nameless = every.where(F.col("id").isNull()).select(F.col("id").alias(id_column), F.lit(None).cast("long").alias("class_id"))
    if label is None:
        return members.select(F.col("id").alias(id_column), F.col("item").alias("class_id")).union(nameless)
    known = members.join(label.withColumnRenamed("id", "item"), "item", "left")
    return known.select(F.col("id").alias(id_column), F.coalesce("component", "item").alias("class_id")).union(nameless)


def kept(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents whose id is their class id: one of each class. Rows that repeat that id stay, and so do rows with a null id."""
    found = classes(docs, id_column, text_column)
    away = found.where(F.col(id_column) != F.col("class_id")).select(id_column).distinct()
    return docs.join(away, id_column, "left_anti")
