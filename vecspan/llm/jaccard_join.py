"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Exact: no pair at or above the threshold is lost, whatever the order of shingles or the estimates.

1. Texts with equal shingle sets form a *class*; only classes are joined.
2. All documents order their shingles alike: shingles that a fixed-size table estimates as frequent
   come last. With ``n`` shingles and ``T = ceil(threshold * n)``, the first ``n - T + l`` of them are
   the document's l-prefix; two similar documents share at least l shingles of their l-prefixes.
   Each document lengthens its prefix (raises l) for as long as that lowers its estimated cost of
   postings plus candidates, and a pair is verified only when it shares min(l_a, l_b) prefix shingles.
3. Postings are shuffled by shingle, in ROUNDS rounds at most that each take a share of all shingles, and pairs count their
   matches, inside each partition before they are shuffled. Of g rounds, one at least has l / g of a pair's l matches, so
   that a round drops the pairs that have fewer. Only sizes that allow the threshold make a pair. A shingle whose classes would make more than
   DENSE pairs each, as in large groups of near copies, makes none: its classes join the *family* of their least class.
   Candidate pairs form families around their least classes too. So all that is shuffled grows with the postings.
   A shingle of more than SALT classes is split, so that each two parts of it meet in some task.
4. A family's sets meet in blocks: one block, or each pair of sub-blocks of a large family. All intersections in a block are
   counted from its own inverted index. Blocks take turns too, so that only a part of the sets is shuffled at a time. Two classes that share several families are compared in the least of these.
   A block returns one row for each class: the copies linked to it there, and the least class it is connected to.
5. Components come from star contraction over classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shingles import shingle_sets
from .storage import materialize, release, trimmed

PERCENT = 70
MIN_BITS, MAX_BITS = 22, 25  #: log2 of the counters of the frequency sketch, by the upper bits of a shingle
DOC_COUNTERS = 16  #: counters for each document, between these bounds
SLICE = 1 << 16  #: counters that are summed in one row
HEAVY = 1 << 5  #: one counter of so many may count as frequent; bounds what is broadcast
STEPS = 8  #: levels of frequency for each power of two
ROUNDS = 5  #: most rounds of postings
ROUND_POSTINGS = 24_000_000  #: postings of a round, about, while there are fewer than ROUNDS
ROUND_SHARE = 4  #: one of so many shingles of all sets is shuffled at a time, about
ROUND_SHINGLES = 1 << 27  #: or as many as this
MIN_L, MAX_L = 6, 12  #: of sets that have as many needed matches
VERIFY_COST = 8.0  #: cost of a candidate, in postings
COLD = 0.05  #: candidates expected of a shingle that isn't frequent
DENSE = 16  #: pairs for each class of a shingle that still are made
SALT = 1_000_000  #: postings of a frequent shingle that one task gets, about
BLOOM_BITS = 1 << 25
BLOCK_BYTES = 4 << 20  #: of the sets of a block, about
CELLS = 2_000_000  #: counters of intersections that are held at once, about
MAX_N = (1 << 24) - 1  #: larger sizes count as this where sizes are only compared
SEEN = 1 << 20  #: classes that a task remembers to emit each once


def _batch_rows(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray]]:
    ids = batch.column("doc_id").to_pylist() if "doc_id" in batch.schema.names else [None] * batch.num_rows
    return zip(ids, shingle_sets(batch.column("text")))


def _class_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


class _Once(set):
    """Says of a class whether the task met it first; forgets all when full."""

    def first(self, c: int) -> bool:
        if c in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(c)
        return True


def _sketch_bits(docs: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, (docs * DOC_COUNTERS - 1).bit_length()))


def _classes(bits: int):
    """Rows of (doc_id, class, n); in the end the task's sketch, in rows of (slice as n, sketch)."""
    names, shift = ["doc_id", "cls", "n", "sketch"], np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, once = np.zeros(1 << bits, np.uint8), _Once()
        for batch in batches:
            ids, cls, n = [], [], []
            for doc_id, s in _batch_rows(batch):
                c = _class_of(s)
                ids.append(doc_id)
                cls.append(c)
                n.append(len(s))
                if len(s) and once.first(c):
                    # repeats of a bucket in one document count once, and a task counts up to 255: a sketch needn't be exact
                    at = (s >> shift).astype(np.int64)
                    counts[at] = np.minimum(counts[at], 254) + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(ids), pa.binary())], names)
        for k in range(len(counts) // SLICE):
            part = counts[k * SLICE : (k + 1) * SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names)

    return run


def _hot_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice, the buckets that stand out from the even load of rare shingles, with levels of their counts, as (place, level) in 24 and 8 bits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column("n").to_pylist(), batch.column("sketch")):
            total = sums.setdefault(k, np.zeros(SLICE, np.int64))
            total += np.frombuffer(x.as_buffer(), np.uint8)
    for k, total in sums.items():
        load = float(np.median(total))
        hot = np.flatnonzero(total > load + 6 * load**0.5 + 2)
        hot = hot[np.argsort(-total[hot], kind="stable")[: SLICE // HEAVY]]
        level = np.minimum(np.log2(total[hot]) * STEPS, 255).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([(hot.astype(np.uint32) << 8 | level).tobytes()], pa.binary())], ["slice", "hot"])


class _Heavy:
    """Estimated frequencies of frequent shingles; of all others 0."""

    def __init__(self, sketches: DataFrame, bits: int) -> None:
        # written, not only collected: the tasks' sketches are two thirds of a large input, and their shuffle files go with a written table
        hot = materialize(sketches.repartition((1 << bits) // SLICE, "n").mapInArrow(trimmed(_hot_buckets), "slice long, hot binary"), "hot")
        self.bits, self.slices = bits, [(r[0], zlib.compress(r[1], 1)) for r in hot.collect()]
        release(hot)

    def table(self) -> "_Frequencies":
        return _Frequencies(self)


class _Frequencies:
    """A level for each bucket: of a count c, log2(c) * STEPS."""

    def __init__(self, heavy: _Heavy) -> None:
        self.shift = np.uint64(64 - heavy.bits)
        self.levels = np.zeros(1 << heavy.bits, np.uint8)
        for k, packed in heavy.slices:
            x = np.frombuffer(zlib.decompress(packed), np.uint32)
            self.levels[(x >> 8) + k * SLICE] = x & 255
        self.counts = np.round(2 ** (np.arange(256) / STEPS)).astype(np.int64)
        self.counts[0] = 0

    def __getitem__(self, s: np.ndarray) -> np.ndarray:
        return self.counts[self.levels[(s >> self.shift).astype(np.int64)]]


def choose_prefix(counts: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(l, prefix length) of least estimated cost, given the frequencies of the ordered shingles."""
    need = -(-n * percent // 100)
    ls = np.arange(min(MIN_L, need), max(1, min(MAX_L, need)) + 1)
    lengths = n - need + ls
    met = np.concatenate([np.zeros(1), np.cumsum(counts)])[lengths] + COLD * lengths
    k = int(np.argmin(lengths + met + VERIFY_COST * met / ls))
    return int(ls[k]), int(lengths[k])


def prefix_of(s: np.ndarray, freq: "_Frequencies", percent: int) -> tuple[np.ndarray, int]:
    """A set's adaptive prefix, rarest shingles first, and its l."""
    f = freq[s]
    if f.any():
        order = np.argsort(f, kind="stable")
        s, f = s[order], f[order]
    l, length = choose_prefix(f, len(s), percent)
    return s[:length], l


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values."""
    at = np.flatnonzero(np.concatenate([np.ones(1, bool), x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(x)))


def _salted(h: np.ndarray, cls: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) so that each two classes of a shingle share a key, each of which has two of ``parts`` parts."""
    rows = np.repeat(np.arange(len(h)), parts)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = (cls[rows].view(np.uint64) % parts[rows].astype(np.uint64)).astype(np.int64)
    low, high = np.minimum(mine, other).astype(np.uint64), np.maximum(mine, other).astype(np.uint64)
    with np.errstate(over="ignore"):
        return h[rows] + (low << np.uint64(32) | high) * np.uint64(0x9E3779B97F4A7C15), rows


def _postings(heavy: _Heavy, percent: int, rounds: int = 1, turn: int = 0):
    """(h, cls, nb): a shingle of the class's prefix that has its turn, with n and l in nb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, once = heavy.table(), _Once()
        out: list[tuple[np.ndarray, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            sizes = [len(x[0]) for x in out]
            h = np.concatenate([x[0] for x in out])
            cls, n, l = (np.repeat(np.array([x[k] for x in out], np.int64), sizes) for k in (1, 2, 3))
            nb = l << 24 | np.minimum(n, MAX_N)
            parts = freq[h] // SALT + 1
            if parts.max() > 1:
                h, rows = _salted(h, cls, parts)
                cls, nb = cls[rows], nb[rows]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls), pa.array(nb)], ["h", "cls", "nb"])

        held = 0
        for batch in batches:
            for _, s in _batch_rows(batch):
                if not len(s) or not once.first(c := _class_of(s)):
                    continue
                prefix, l = prefix_of(s, freq, percent)
                if rounds > 1:
                    prefix = prefix[prefix % np.uint64(rounds) == turn]
                out.append((prefix, c, len(s), l))
                held += len(prefix)
                if held > 200_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def _combine(parts: list[np.ndarray]) -> np.ndarray:
    """Each pair of a kind once; columns a, b, kind, both sizes with l below, and the sum of its matches."""
    x = np.concatenate(parts)
    x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
    new = np.flatnonzero(np.concatenate([np.ones(1, bool), (x[1:, :3] != x[:-1, :3]).any(1)]))
    y = x[new]
    y[:, 5] = np.add.reduceat(x[:, 5], new)
    return y


def _pairs(percent: int):
    names = ["a", "b", "kind", "na", "nb", "met"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of postings in the order of (h, cls): pairs with their matches (kind 0), and (family, class) as kind 1."""
        parts: list[np.ndarray] = []
        held = 0

        def add(cls: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            nonlocal held
            swap = cls[i] > cls[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            x, y, one = nb[i], nb[j], np.ones(len(i), np.int64)
            parts.append(np.stack([cls[i], cls[j], one * 0, (x & MAX_N) << 8 | x >> 24, (y & MAX_N) << 8 | y >> 24, one], 1))
            held += len(one)

        def large(cls: np.ndarray, nb: np.ndarray) -> None:
            """One shingle's classes: pairs, or a family for each stretch of sizes without a gap that no link spans."""
            nonlocal held
            by = np.argsort(nb & MAX_N, kind="stable")
            cls, nb = cls[by], nb[by]
            n = nb & MAX_N
            upto = np.searchsorted(n, 100 * n // percent, "right") - np.arange(len(n)) - 1
            if upto.sum() <= DENSE * len(n):
                i = np.repeat(np.arange(len(n)), upto)
                add(cls, nb, i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(upto) - upto, upto))
                return
            for part in np.split(cls, np.flatnonzero(upto[:-1] == 0) + 1):
                if len(part) > 1:
                    zero = np.zeros(len(part), np.int64)
                    parts.append(np.stack([zero + part.min(), part, zero + 1, zero, zero, zero], 1))
                    held += len(part)

        def groups(h: np.ndarray, cls: np.ndarray, nb: np.ndarray) -> Iterator[None]:
            at, size = _runs(h)
            for start, m in zip(at[size > DENSE].tolist(), size[size > DENSE].tolist()):
                large(cls[start : start + m], nb[start : start + m])
                yield
            for m in range(2, DENSE + 1):
                starts = at[size == m]
                i, j = np.triu_indices(m, 1)
                step = max(1, 1_000_000 // len(i))
                for k in range(0, len(starts), step):
                    base = starts[k : k + step, None]
                    i2, j2 = (base + i).ravel(), (base + j).ravel()
                    n, o = nb[i2] & MAX_N, nb[j2] & MAX_N
                    ok = 100 * np.minimum(n, o) >= percent * np.maximum(n, o)
                    if ok.any():
                        add(cls, nb, i2[ok], j2[ok])
                        yield

        def emit(rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, held
            if held > 1_500_000 or rest and held:
                x = _combine(parts)
                parts, held = [x], len(x)
                if held > 1_000_000 or rest:
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(6)], names)
                    parts, held = [], 0

        left: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "cls", "nb")]
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if not cut and left[0] and left[0][-1][-1] == new[0][0]:
                for old, x in zip(left, new):
                    old.append(x)
                continue
            h, cls, nb = (np.concatenate([*old, x[:cut]]) for old, x in zip(left, new))
            left = [[x[cut:]] for x in new]
            keep = np.concatenate([np.ones(1, bool), (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])]) if len(h) else np.empty(0, bool)
            for _ in groups(h[keep], cls[keep], nb[keep]):
                yield from emit(False)
        if left[0]:
            h, cls, nb = (np.concatenate(old) for old in left)
            keep = np.concatenate([np.ones(1, bool), (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])])
            for _ in groups(h[keep], cls[keep], nb[keep]):
                yield from emit(False)
        yield from emit(True)

    return run


def _bloom_at(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = cls.view(np.uint64)
    return (x % np.uint64(BLOOM_BITS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _bloom_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BLOOM_BITS, bool)
    for batch in batches:
        for at in _bloom_at(batch.column("cls").to_numpy(zero_copy_only=False)):
            bits[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def _sets(bloom: np.ndarray):
    """(class, set) of each class that the filter lets through; what it lets through wrongly a join drops later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            out: list[tuple[int, bytes]] = []
            held = 0
            for _, s in _batch_rows(batch):
                c = _class_of(s)
                x = np.array([c], np.int64)
                if len(s) and all(bloom[at[0] >> 3] >> (7 - (at[0] & 7)) & 1 for at in _bloom_at(x)) and once.first(c):
                    out.append((c, s.tobytes()))
                    held += len(out[-1][1])
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["cls", "shingles"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["cls", "shingles"])

    return run


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of all sets of x with all of y: (first row, counts) for some rows of x at a time."""
    flat, sizes = np.concatenate(y), np.array([len(s) for s in y])
    owner = np.repeat(np.arange(len(y)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    at = 0
    while at < len(x):
        to, met = at, 0
        spans = []
        while to < len(x) and (to == at or (to - at + 1) * len(y) <= CELLS and met <= CELLS):
            low, high = np.searchsorted(flat, x[to]), np.searchsorted(flat, x[to], "right")
            some = high > low
            spans.append((low[some], (high - low)[some]))
            met += int(spans[-1][1].sum())
            to += 1
        counts = np.zeros((to - at, len(y)), np.int64)
        low, size = np.concatenate([s[0] for s in spans]), np.concatenate([s[1] for s in spans])
        row = np.repeat(np.arange(to - at), [len(s[0]) for s in spans])
        if len(low):
            each = np.repeat(low - np.concatenate([np.zeros(1, np.int64), np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            counts = np.bincount(np.repeat(row, size) * len(y) + owner[each], minlength=counts.size).reshape(counts.shape)
        yield at, counts
        at = to


def _met_before(family: int, mine: list[list[int]], other: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the pairs that share a lesser family than this, and are compared there."""
    by: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
    for held, each in zip(by, (mine, other)):
        for k, families in enumerate(each):
            for f in families:
                if f < family:
                    held.setdefault(f, []).append(k)
    return [(np.array(rows), np.array(by[1][f])) for f, rows in by[0].items() if f in by[1]]


def _linked(family: int, x: list[dict], y: list[dict], same: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the links between classes of x and of y; each link of x with itself from both sides."""
    sets = [[np.frombuffer(r["shingles"], np.uint64) for r in each] for each in (x, y)]
    n = [np.array([len(s) for s in each]) for each in sets]
    skip = _met_before(family, [r["families"] for r in x], [r["families"] for r in y])
    for at, counts in _overlaps(*sets):
        rows = np.arange(at, at + len(counts))
        good = 100 * counts >= percent * (n[0][rows][:, None] + n[1][None, :] - counts)
        if same:
            good[np.arange(len(rows)), rows] = False
        for mine, other in skip:
            mine = mine[(mine >= at) & (mine < at + len(counts))] - at
            if len(mine):
                good[np.ix_(mine, other)] = False
        for k in np.flatnonzero(good.any(1)).tolist():
            yield at + k, np.flatnonzero(good[k])


def _verify(percent: int, pairs: bool):
    """A block's classes: with ``pairs`` all links (cls, other), else (cls, near, label) of each linked class."""

    def run(rows: pa.Table) -> pa.Table:
        groups: dict[tuple[int, int, int], tuple[list[dict], list[dict]]] = {}
        for r in rows.to_pylist():
            groups.setdefault((r["family"], r["p"], r["q"]), ([], []))[int(r["sub"] != r["p"])].append(r)
        cls, second, third = [], [], []
        for (family, p, q), (x, y) in groups.items():
            same = p == q
            y = x if same else y
            if not x or not y or same and len(x) < 2:
                continue
            names = np.array([r["cls"] for r in x] + ([] if same else [r["cls"] for r in y]))
            sizes = np.array([r["size"] for r in x] + ([] if same else [r["size"] for r in y]))
            shift = 0 if same else len(x)
            near, label = np.zeros(len(names), np.int64), np.arange(len(names))
            for i, others in _linked(family, x, y, same, percent):
                others = others + shift
                if pairs:
                    others = others[others > i]
                    cls.append(np.minimum(names[i], names[others]))
                    second.append(np.maximum(names[i], names[others]))
                    continue
                near[i] += sizes[others].sum()
                if not same:
                    near[others] += sizes[i]
                roots = np.unique(np.append(label[others], label[i]))
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
            some = np.flatnonzero(near)
            if len(some):
                least = np.full(len(names), np.iinfo(np.int64).max)
                np.minimum.at(least, label, names)
                cls.append(names[some])
                second.append(near[some])
                third.append(least[label[some]])
        fields = [("cls", cls), ("other", second)] if pairs else [("cls", cls), ("near", second), ("label", third)]
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in fields})

    return run


def _families(docs: DataFrame, members: DataFrame, heavy: _Heavy, percent: int) -> DataFrame:
    """(family, cls), each once: every two classes that may meet the threshold share a family."""
    of = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = int(min(ROUNDS, max(1, -(-of * (100 - percent) // 100 // ROUND_POSTINGS))))
    # a pair with l matches has l / rounds in some round; a round without that many has one less at most
    least = F.least(F.col("na") % 256, F.col("nb") % 256)
    few = F.ceil(least / rounds)
    parts = []
    for turn in range(rounds):
        postings = docs.select("text").mapInArrow(trimmed(_postings(heavy, percent, rounds, turn)), "h long, cls long, nb long")
        met = postings.repartition("h").sortWithinPartitions("h", "cls").mapInArrow(trimmed(_pairs(percent)), "a long, b long, kind long, na long, nb long, met long")
        counted = met.groupBy("a", "b", "kind").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("met").alias("met"))
        parts.append(materialize(counted.where((F.col("kind") == 1) | (F.col("met") >= few)).select("a", "b", "kind", (F.col("met") - few + 1).alias("more"), (least - rounds * (few - 1)).alias("over")), "candidates"))
    found = parts[0]
    if rounds > 1:
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        found = materialize(every.groupBy("a", "b", "kind").agg(F.sum("more").alias("more"), F.first("over").alias("over")).where("kind = 1 or more >= over"), "candidates")
        release(*parts)
    dense = found.where("kind = 1").select(F.col("a").alias("family"), F.col("b").alias("cls"))
    pairs = found.where("kind = 0").select("a", "b")
    least = pairs.union(pairs.select("b", "a")).groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    led = pairs.join(least, "a").join(least.select(F.col("a").alias("b"), F.col("least").alias("other")), "b").select("a", "b", F.least("least", "other").alias("family"))
    each = led.select("family", F.explode(F.array("a", "b")).alias("cls"))
    families = materialize(dense.union(each).distinct(), "families")
    release(found)
    return families


def _largest(families: DataFrame) -> DataFrame:
    """``families`` without those whose classes are all in a larger family (or an equal one of lesser name), as far as the least class's families show."""
    of = families.groupBy("cls").agg(F.collect_list("family").alias("own"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    met = families.join(of, "cls").join(of.select(F.col("cls").alias("family"), F.col("own").alias("leads")), "family")
    shared = met.select("family", F.explode(F.array_intersect("own", "leads")).alias("by")).where("by <> family").groupBy("family", "by").agg(F.count(F.lit(1)).alias("k"))
    inside = shared.join(sizes, "family").where("k = m").join(sizes.select(F.col("family").alias("by"), F.col("m").alias("most")), "by")
    gone = inside.where("most > m or most = m and by < family").select("family").distinct()
    return families.join(gone, "family", "left_anti").join(sizes.where("m > 1").select("family"), "family", "left_semi")


def _compared(docs: DataFrame, percent: int, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(members, what the blocks say)."""
    docs = docs.select("doc_id", "text")
    bits = _sketch_bits(docs.count())
    first = materialize(docs.mapInArrow(trimmed(_classes(bits)), "doc_id long, cls long, n long, sketch binary"), "classes")
    heavy = _Heavy(first.where("cls is null").select("n", "sketch"), bits)
    members = materialize(first.where("cls is not null").select("doc_id", "n", "cls"), "members")
    release(first)
    classes = members.where("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
    met = _families(docs, members, heavy, percent)
    families = materialize(_largest(met).join(classes, "cls"), "families")
    release(met)
    sized = families.groupBy("family").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.sum("n") * 8 / BLOCK_BYTES).alias("subs")).where("m > 1").drop("m")
    sub = F.pmod(F.xxhash64("cls"), F.col("subs"))
    placed = families.join(sized, "family").withColumn("sub", sub).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)))
    placed = materialize(placed.select("family", "cls", "size", "n", "subs", "sub", F.least("sub", "with").alias("p"), F.greatest("sub", "with").alias("q")), "placed")
    kind = "cls long, other long" if pairs else "cls long, near long, label long"
    total, widest = placed.agg(F.sum("n"), F.max("subs")).first()
    if not total:
        return members, docs.sparkSession.createDataFrame([], kind)

    whole = members.agg(F.sum("n")).first()[0]
    rounds = -(-total // max(ROUND_SHINGLES, whole // ROUND_SHARE))
    blocks = max(4, -(-total * 8 // BLOCK_BYTES))
    alone = F.pmod(F.xxhash64("family"), F.lit(blocks))
    block = alone if widest == 1 else F.when(F.col("subs") == 1, alone).otherwise(F.xxhash64("family", "p", "q"))
    of = families.groupBy("cls").agg(F.collect_list("family").alias("families"))
    links = []
    for turn in range(rounds):
        now = placed.withColumn("block", block)
        now = now if rounds == 1 else now.where(F.pmod("block", F.lit(rounds)) == turn)
        bloom = np.zeros(BLOOM_BITS // 8, np.uint8)
        for row in now.select("cls").distinct().coalesce(4).mapInArrow(trimmed(_bloom_part), "bits binary").toLocalIterator():
            bloom |= np.frombuffer(row[0], np.uint8)
        sets = docs.select("text").mapInArrow(trimmed(_sets(bloom)), "cls long, shingles binary").dropDuplicates(["cls"])
        sent = now.drop("n", "subs").join(of, "cls").join(sets, "cls")
        links.append(materialize(sent.groupBy("block").applyInArrow(_verify(percent, pairs), kind), "links"))
    release(placed, families)
    every = links[0]
    for part in links[1:]:
        every = every.union(part)
    return members, every


def similar_classes(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the join.

    ``members`` has doc_id, n (shingles) and cls of every row; ``links`` has one row (a < b) for each
    pair of classes that meet the threshold. Texts without words have n = 0 and no links.
    """
    members, links = _compared(docs, percent, True)
    return members, links.select(F.col("cls").alias("a"), F.col("other").alias("b"))


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, n_similar, component_id.

    ``n_similar`` counts the other rows that are linked directly (100 * intersection >= percent * union),
    copies included; ``component_id`` is the smallest doc_id that links reach, the row's own included.
    Null and wordless texts have n_shingles 0, n_similar 0 and their own doc_id. Repeated rows count
    as copies of each other. Other columns are ignored. A null doc_id counts as a row but never
    becomes a component_id, unless its whole component has no other. Long texts count whole.
    """
    members, links = _compared(docs, percent, False)
    classes = members.where("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("least_id"))
    degree = links.groupBy("cls").agg(F.sum("near").alias("near"))
    labels = connected_components(links, "cls", "label").select(F.col("node").alias("cls"), "label")
    sizes = classes.join(degree, "cls", "left").join(labels, "cls", "left").where("size > 1 or near is not null")
    sizes = sizes.select("cls", "size", "near", "least_id", F.coalesce("label", "cls").alias("label"))
    least = sizes.groupBy("label").agg(F.min("least_id").alias("component_id"))
    stats = sizes.join(least, "label").select("cls", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_similar"), "component_id")
    return members.join(stats, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("n_similar", F.lit(0))).otherwise(0).cast("long").alias("n_similar"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
