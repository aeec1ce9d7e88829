"""MinHash near-dedup by chosen-path set similarity join.

A document's set is its distinct 5-word shingles. Documents with equal sets form one class first; classes carry K minwise
values. A tree of the join sends each class, at the root, to one or two nodes chosen by a minwise value. A node with up to LIMIT
classes is compared exhaustively inside one task. A larger one whose classes are one component but for LIMIT is cut into
strips, each part of the component with all the others; any other branches again on further values, chosen by the node's
own path. TREES independent roots repeat this, so that a pair at the threshold shares no root node with a chance below
2e-5. What stays large below all branchings is compared exhaustively too, as tiles of TILE by TILE classes.

Comparing means a sketch first: one permutation's least hash in each of BINS bins, whose agreement over the bins that
either set fills estimates the similarity. A pair is a candidate if its sizes allow the threshold (exact) and the estimate
is no further below it than DEVIATIONS standard deviations (a chance below 1e-5 for a pair at the threshold). Candidates
meet a wider sketch and are then confirmed on full sets. Two rounds take from each node a spanning forest of its
candidates, the most similar pairs first; after those only candidates between different components are left. The last
round finds the classes that are in any, and confirms all of those pairs that the wider sketch allows. That loses no link between components and never expands a group of copies into pairs.

Full sets hold shingles as 64-bit hashes of their words' hashes: two different shingles are taken for one by chance alone,
about 2^-64 a pair. A key that holds a large share of all rows, such as a node with a passage that most documents have, is
joined by a broadcast of fewer than 10,000 of the heaviest keys, the rest by a shuffle.

Below nodes of more than LIMIT classes the trees draw from the same values of each level, so their misses go together: a
pair at the threshold that meets only in such nodes, and has no other path, is lost with a chance of about 0.2 % after one
level and up to 0.7 % after four.

Two passes over the texts: one makes the minwise values (numbers only, no text leaves its task), the other makes full
sets for those classes alone that stand in a candidate pair. Links, components and sets stay distributed.

Defined cases: a null text or one without words has an empty set, size 0, and is linked with nothing. A text with one to
four words has its whole sequence as its one shingle. Rows with a null doc_id can't be named: they take no part in
linking, have a null component and are kept. Rows that share a doc_id are one document with several texts: they share
a component. Repeated rows come back as often as they came. Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.hot import join_sums
from .memory import tidy
from .store import materialize
from .words import buffers, chunks, mix, words

SHINGLE = 5
#: Similarity in hundredths: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
K = 32
TREES = 6
#: Root coordinates of the trees: one or two each, 1 / 0.75 on average, none twice.
ROOTS = tuple((2 * t, 2 * t + 1) if t % 3 == 0 else (2 * t,) for t in range(TREES))  # 8 in all
#: Further levels, each with values of its own to choose from.
LEVELS = tuple(tuple(range(2 * TREES + 5 * i, 2 * TREES + 5 * i + 5)) for i in range(4))
LIMIT = 1024
#: Classes on a side of a tile.
TILE = 256
BINS = 128
BATCH_ROWS = 32
#: Bins of the wider sketch that candidates meet before full sets do.
WIDE = 1024
DEVIATIONS = 4.5


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes of each text, ascending, and n + 1 offsets of the texts in them."""
    w, at = words(raw, offsets)
    n = np.diff(at)
    many = np.maximum(n - SHINGLE + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(many)])
    weights = _constants(SHINGLE + 1, 11)
    run = len(w) - SHINGLE + 1
    out = np.zeros(to[-1], np.uint64)
    if run > 0:
        h = w[:run] * weights[0]
        for k in range(1, SHINGLE):
            h += w[k : k + run] * weights[k]
        long = n >= SHINGLE
        # windows that stay inside a text: all starts but each text's last SHINGLE - 1
        inside = np.ones(len(w), bool)
        for k in range(1, SHINGLE):
            last = at[1:] - k
            inside[last[(last >= at[:-1])]] = False
        places = np.flatnonzero(inside[:run]) if long.any() else np.zeros(0, np.int64)
        fill = np.repeat(long, many)
        out[fill] = h[places]
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        v = w[at[i] : at[i + 1]]
        out[to[i]] = np.append(v * weights[: len(v)], weights[SHINGLE:] * n[i : i + 1].astype(np.uint64)).sum(dtype=np.uint64)
    out = mix(out)
    for i in range(len(n)):
        out[to[i] : to[i + 1]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[to[:-1][many > 0]] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], count[to]


def minwise(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """K minwise values of each set, upper 32 bits, shape (n, K); 0 for empty sets."""
    n = np.diff(at)
    out = np.zeros((len(n), K), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        times, plus = _constants(K, 23), _constants(K, 37)
        for k in range(K):
            out[full, k] = np.minimum.reduceat((sets ^ plus[k]) * times[k], at[:-1][full]) >> np.uint64(32)
    return out


def binned(sets: np.ndarray, at: np.ndarray, many: int = BINS) -> np.ndarray:
    """One byte of the least hash in each of `many` bins of each set, shape (n, many); 0 marks an empty bin."""
    out = np.zeros((len(at) - 1, many), np.uint8)
    bins = (sets >> np.uint64(64 - many.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = bins[1:] != bins[:-1]
    n = np.diff(at)
    first[at[:-1][n > 0]] = True  # sets ascend, so a bin's first hash is its least
    own = np.repeat(np.arange(len(n)), n)[first]
    out[own, bins[first]] = (sets[first] >> np.uint64(16)) % np.uint64(255) + np.uint64(1)
    return out


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-ordered matrix."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, mh binary, bins binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for i, j, part, at in chunks(raw, offsets):
            sets, to = shingle_sets(part, at)
            n = np.diff(to)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
            other = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
            f1, f2 = mix(total[to[1:]] - total[to[:-1]]).view(np.int64), mix(other[to[1:]] - other[to[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), fixed_binary(minwise(sets, to)), fixed_binary(binned(sets, to))], ["doc_id", "n_shingles", "f1", "f2", "mh", "bins"])


def _tidied(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        tidy()

    return run


def sketches(docs: DataFrame) -> DataFrame:
    """One row for each document: set size, 128-bit fingerprint of the set, minwise values."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tidied(_sketch), SKETCH)


def value(k: int) -> Column:
    return F.substring("mh", 4 * k + 1, 4)


def root_nodes(classes: DataFrame) -> DataFrame:
    """(node, rep): the nodes at the trees' roots."""
    keys = F.array(*[F.xxhash64(F.lit(t), F.lit(k), value(k)) for t, ks in enumerate(ROOTS) for k in ks])
    return classes.select(F.explode(keys).alias("node"), "rep")


def child_nodes(members: DataFrame, level: int) -> DataFrame:
    """(node, rep) below members (node, rep, mh): two values of this level, chosen by the node."""
    own = LEVELS[level]
    first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(len(own)))
    second = (first + 1 + F.pmod(F.xxhash64("node", F.lit(level), F.lit(1)), F.lit(len(own) - 1))) % len(own)
    picks = F.array(first, second)
    child = F.transform(picks, lambda k: F.xxhash64("node", k, F.substring(F.col("mh"), (k + own[0]).cast("int") * 4 + 1, F.lit(4))))
    return members.select(F.explode(child).alias("node"), "rep")


MEMBERS = "array<struct<rep:long,n:long,bins:binary,c:long>>"


def _likely(n: np.ndarray, n2: np.ndarray, bins: np.ndarray, bins2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes and sketches allow the threshold, and the estimates; row by row, either side may be one row."""
    t = THRESHOLD / 100
    filled = np.maximum(((bins > 0) | (bins2 > 0)).sum(1), 1)
    estimate = ((bins == bins2) & (bins > 0)).sum(1) / filled
    # filled bins are a sample without replacement of the union, which at the threshold has this size
    union = np.maximum((n + n2) / (1 + t), filled)
    spread = np.sqrt(t * (1 - t) / filled * (union - filled + 1) / union)
    ok = estimate >= t - DEVIATIONS * spread
    return ok & (100 * np.minimum(n, n2) >= THRESHOLD * np.maximum(n, n2)), estimate


def _candidates(n: np.ndarray, bins: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs i < j of different components that _likely allows, with estimates."""
    found = []
    for i in range(len(n) - 1):
        js = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= THRESHOLD * np.maximum(n[i + 1 :], n[i])))
        if len(js):
            ok, estimate = _likely(n[js], n[i], bins[js], bins[i])
            found.append((np.full(ok.sum(), i), js[ok], estimate[ok]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(node, rep, n, sketch, component) arrays of each row (node, members) that holds several components."""
    for node, members in zip(batch.column(0), batch.column(1), strict=True):
        s = members.values
        rep, n, comp = (s.field(k).to_numpy(zero_copy_only=False) for k in ("rep", "n", "c"))
        if len(rep) > 1 and not (comp == comp[0]).all():
            yield node.as_py(), rep, n, buffers(s.field("bins"))[0].reshape(len(rep), -1), comp


def _forest(i: np.ndarray, j: np.ndarray, estimate: np.ndarray, comp: np.ndarray) -> list[int]:
    """Numbers of the pairs that join components without a cycle, the most similar first."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    picked = []
    for k in np.argsort(-estimate, kind="stable"):
        x, y = top(int(comp[i[k]])), top(int(comp[j[k]]))
        if x != y:
            up[max(x, y)] = min(x, y)
            picked.append(k)
    return picked


def _compare(forest: bool):
    """(node, members) to pairs (a < b): a spanning forest of the candidates, or all between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 2), np.int64)]
            for _, rep, n, bins, comp in _groups(batch):
                i, j, estimate = _candidates(n, bins, comp)
                if forest:
                    picked = _forest(i, j, estimate, comp)
                    i, j = i[picked], j[picked]
                out.append(np.column_stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])]))
            pairs = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, members) to the members (node, rep) that are in a candidate pair between different components."""
    for batch in batches:
        out = [np.zeros((0, 2), np.int64)]
        for node, rep, n, bins, comp in _groups(batch):
            i, j, _ = _candidates(n, bins, comp)
            some = np.unique(np.concatenate([i, j]))
            out.append(np.column_stack([np.full(len(some), node, np.int64), rep[some]]))
        rows = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["node", "rep"])


def _listed(members: DataFrame) -> DataFrame:
    """One row for each small node or tile: the list of its members."""
    return members.groupBy("node").agg(F.collect_list(F.struct("rep", "n", "bins", "c")).cast(MEMBERS).alias("members")).where(F.size("members") > 1)


def _star(many: int):
    """Rows (a, b, n, n2, sketch, sketch2) to the pairs that _likely allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3)]
            bins = [buffers(batch.column(k))[0].reshape(-1, many) for k in (4, 5)]
            ok, _ = _likely(ids[2], ids[3], *bins)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][ok]), pa.array(ids[1][ok])], ["a", "b"])

    return run


def _star_pairs(members: DataFrame, total: int) -> DataFrame:
    """Candidates among the pairs of large nodes' members with their node's least class. A join, no lists."""
    least = members.groupBy("node").agg(F.min(F.struct("rep", "n", "bins")).alias("_l"), F.count(F.lit(1)).alias("_many"))
    both = join_sums(members, least, "node", "_many", total).where("rep <> _l.rep")
    return both.select(F.col("_l.rep").alias("a"), F.col("rep").alias("b"), F.col("_l.n").alias("n"), F.col("n").alias("n2"), F.col("_l.bins").alias("bins"), F.col("bins").alias("bins2")).mapInArrow(_star(BINS), "a long, b long")


SETS = "rep long, n long, wide binary, shingles binary"


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column(1))
        for i, j, part, at in chunks(raw, offsets):
            sets, to = shingle_sets(part, at)
            full = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(to * 8), pa.py_buffer(sets)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(to)), fixed_binary(binned(sets, to, WIDE)), full], ["rep", "n", "wide", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for r in range(batch.num_rows):
            x = np.frombuffer(batch.column(2)[r].as_buffer(), np.uint64)
            y = np.frombuffer(batch.column(3)[r].as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok[r] = len(both) > 0 and 100 * shared >= THRESHOLD * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], ["a", "b", "linked"])


#: Bits of the map that thins texts before they are joined to ids: 256 rows of 4 KiB at most.
MAP_BITS = 1 << 23


def _bitmaps(ids: DataFrame) -> tuple[Column, DataFrame]:
    """A row's place in the map, by its rep, and the map: rows (_m, _bits), of fixed size in all."""
    place = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS)) + 1
    return place, ids.groupBy(F.bitmap_bucket_number(place).alias("_m")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def _bit(place: Column) -> Column:
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int"))


def _maybe(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts whose rep may be among ids: all that are, and some others. A bitmap of fixed size is broadcast, so that the
    join that follows shuffles few texts."""
    place, maps = _bitmaps(ids)
    near = texts.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_m"))
    return near.where(_bit(place) == 1).select("rep", "text")


class _Join:
    """State of one run: texts, full sets at hand, pairs already judged."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.sets: DataFrame | None = None
        self.judged: DataFrame | None = None

    def need(self, ids: DataFrame) -> None:
        """Have the full sets of these classes (distinct rep) at hand."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("rep").distinct(), "rep", "left_anti")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
        # an inner join: a semi join would be pushed below the map and shuffle all texts
        mine = _maybe(texts, ids).join(ids, "rep").dropDuplicates(["rep", "text"])
        fresh, _ = materialize(mine.mapInArrow(_tidied(_full_sets), SETS), "sets")
        self.sets = fresh if self.sets is None else self.sets.union(fresh)

    def confirmed(self, pairs: DataFrame, sketched: bool = False) -> DataFrame:
        """Those of the pairs (a, b) of classes that are linked, judged on the full sets of the texts. sketched: their sets
        are at hand and the wide sketches have been met already."""
        if not sketched:
            self.need(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())

        def sides(*what: str) -> list[DataFrame]:
            return [self.sets.select(F.col("rep").alias(c), *[F.col(w).alias(w + t) for w in what]) for c, t in (("a", ""), ("b", "2"))]

        near = pairs
        if not sketched:
            x, y = sides("n", "wide")
            near = pairs.join(x, "a").join(y, "b").select("a", "b", "n", "n2", "wide", "wide2").mapInArrow(_star(WIDE), "a long, b long")
            near, _ = materialize(near, "near")
        x, y = sides("shingles")
        judged = near.join(x, "a").join(y, "b").select("a", "b", "shingles", "shingles2").mapInArrow(_tidied(_confirm), "a long, b long, linked boolean")
        return judged.where("linked").select("a", "b")

    def round(self, pairs: DataFrame, found: DataFrame | None, sketched: bool = False) -> DataFrame:
        """Confirm pairs that no round has judged yet; returns all components."""
        pairs = pairs.distinct()
        if self.judged is not None:
            pairs = pairs.join(self.judged, ["a", "b"], "left_anti")
        pairs, _ = materialize(pairs, "pairs")
        self.judged = pairs if self.judged is None else self.judged.union(pairs)
        links, _ = materialize(self.confirmed(pairs, sketched), "confirmed")
        if found is not None:
            if links.isEmpty():
                return found
            links = links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return materialize(components(links), "components")[0]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs."""
    # rows of pairs and nodes hold whole sets and lists: few of them in a batch bound a worker's memory
    conf, rows = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    conf.set(rows, str(BATCH_ROWS))
    try:
        return _near_duplicates(docs)
    finally:
        conf.set(rows, before)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    made, _ = materialize(sketches(docs), "sketches")
    named = made.where("doc_id is not null and n_shingles > 0")
    same_set = ["n_shingles", "f1", "f2"]
    classes, _ = materialize(named.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.max("mh").alias("mh"), F.max("bins").alias("bins")), "classes")
    sketch = classes.select("rep", F.col("n_shingles").alias("n"), "bins")
    join = _Join(docs)

    nodes = root_nodes(classes)
    counts = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    total = classes.count() * sum(map(len, ROOTS))
    crowded, _ = materialize(join_sums(nodes, counts, "node", "many", total), "nodes")

    # first round: a forest inside each node, or inside parts of a large one, which a star ties together
    members = crowded.join(sketch, "rep").withColumn("c", F.col("rep"))
    parts = members.withColumn("node", F.when(F.col("many") > LIMIT, F.xxhash64("node", _part(F.ceil(F.col("many") / LIMIT)))).otherwise(F.col("node")))
    pairs = _listed(parts).mapInArrow(_tidied(_compare(True)), "a long, b long").union(_star_pairs(members.where(F.col("many") > LIMIT), total))
    found = join.round(pairs, None)

    # what still holds several components, down to small nodes and tiles
    leaves, placed = _leaves(crowded, found, classes, total)
    members = _unsettled(_with_component(leaves, found), placed).join(sketch, "rep")
    found = join.round(_listed(members).mapInArrow(_tidied(_compare(True)), "a long, b long"), found)

    # all that may still join two components, by the wider sketch
    members = _unsettled(_with_component(leaves, found), placed).join(sketch, "rep")
    suspects, _ = materialize(_listed(members).mapInArrow(_tidied(_suspects), "node long, rep long"), "suspects")
    join.need(suspects.select("rep").distinct())
    wide = join.sets.select("rep", "n", F.col("wide").alias("bins"))
    members = _with_component(suspects, found).join(wide, "rep")
    found = join.round(_listed(members).mapInArrow(_tidied(_compare(False)), "a long, b long"), found, sketched=True)

    own, _ = materialize(named.join(classes.select(*same_set, "rep"), same_set).select("doc_id", "n_shingles", "rep"), "own")
    # classes that share a doc_id are linked without a comparison
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_hi")).where("a < _hi").select("doc_id", "a")
    same_id = own.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    if not same_id.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(same_id))
    final = found.select(F.col("node").alias("rep"), "component")
    full = own.join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = made.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    known = found.select(F.col("node").alias("rep"), "component")
    return rows.join(known, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")


def _unsettled(rows: DataFrame, total: int) -> DataFrame:
    """Rows (node, rep, c) of nodes with more than one component, with the node's number of classes, its largest component
    and how many classes stand outside that. total: how many rows there are, about."""
    per = rows.groupBy("node", "c").agg(F.count(F.lit(1)).alias("_n"))
    span = per.groupBy("node").agg(F.sum("_n").alias("many"), F.max(F.struct("_n", "c")).alias("_t"), F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1")
    span = span.select("node", "many", F.col("_t.c").alias("top"), (F.col("many") - F.col("_t._n")).alias("rest"))
    return join_sums(rows.select("node", "rep", "c"), span, "node", "many", total)


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), parts)


def _leaves(crowded: DataFrame, found: DataFrame, classes: DataFrame, total: int) -> tuple[DataFrame, int]:
    """(node, rep): small nodes and tiles below the roots that hold several components; and their number, at most."""
    rows, _ = materialize(_unsettled(_with_component(crowded.select("node", "rep"), found), total), "open")
    leaves = None
    for level in range(len(LEVELS) + 1):
        own = rows.where(F.col("many") <= LIMIT).select("node", "rep").union(_strips(rows.where((F.col("many") > LIMIT) & (F.col("rest") <= LIMIT))))
        leaves = own if leaves is None else leaves.union(own)
        big = rows.where((F.col("many") > LIMIT) & (F.col("rest") > LIMIT))
        many = big.count()
        if not many:
            break
        if level == len(LEVELS):
            leaves = leaves.union(_tiles(big))
            break
        below = child_nodes(big.select("node", "rep").join(classes.select("rep", "mh"), "rep"), level)
        total += 2 * many
        rows, _ = materialize(_unsettled(_with_component(below, found), 2 * many), "open")
    return leaves, total


def _strips(members: DataFrame) -> DataFrame:
    """Large nodes of which few classes stand outside the largest component: parts of that, each with all of those."""
    parts = F.ceil(F.col("many") / LIMIT)
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    strips = members.withColumn("_p", F.explode(F.when(F.col("c") == F.col("top"), F.array(_part(parts))).otherwise(every)))
    return strips.select(F.xxhash64("node", "_p").alias("node"), "rep")


def _tiles(members: DataFrame) -> DataFrame:
    """Large nodes as tiles of about TILE by TILE classes, each pair of parts in one tile."""
    parts = F.ceil(F.col("many") / TILE)
    dealt = members.withColumn("_p", _part(parts)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.select(F.xxhash64("node", F.least("_p", "_o"), F.greatest("_p", "_o")).alias("node"), "rep")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the documents that near_duplicates doesn't keep; of rows that share a kept doc_id one stays.

    Only rows whose doc_id may be among the dropped or repeated ones are shuffled; all others stay where they are.
    """
    judged, _ = materialize(near_duplicates(docs), "judged-docs")
    named = judged.where("doc_id is not null")
    odd, _ = materialize(named.groupBy(F.col("doc_id").alias("rep")).agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("_kept")).where("_n > 1 or not _kept"), "odd")
    tagged = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("rep"))
    place, maps = _bitmaps(odd.select("rep"))
    met = tagged.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_m"), "left").withColumn("_maybe", F.coalesce(_bit(place) == 1, F.lit(False)))
    sure = met.where("not _maybe").select("_doc.*")
    maybe = met.where("_maybe").join(odd, "rep", "left").where("_kept is null or _kept")
    once = maybe.where("_n is null").select("_doc.*").unionByName(maybe.where("_n > 1").dropDuplicates(["rep"]).select("_doc.*"))
    return sure.unionByName(once)
