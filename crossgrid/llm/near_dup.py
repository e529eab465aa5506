"""Near-duplicate classes of documents by a chosen-path set similarity join.

Texts become sets of word shingles; equal sets are one class from the start, so copies never meet.
Each class walks down TREES independent trees. A path is chosen by the minwise token of a coordinate:
classes of one node that share the minimum go to the same child. A path begins with two coordinates;
nodes that are still large branch on, each into one further coordinate or, as often as the threshold
needs to keep the expected number of common nodes of a linked pair at one, into two. Small nodes are
compared exhaustively: sketches give candidate clusters, each cluster once, and links are confirmed on
the full sets, in blocks. Only spanning links leave a node; star contractions join them to components.

Recall: a pair at the threshold t shares a tree's first node with chance t^2, so 16 trees miss it with
(1 - t^2)^16: 1e-9 at 0.85, 8e-8 at 0.8. Its sketches, the same in all trees, fall short with chance 1e-6
at most. In groups so dense that their nodes stay large, the branching
keeps one common leaf per tree in expectation. Large nodes that no longer shrink hold members that agree
nearly everywhere; these are compared within blocks and with the node's pivot block, and then all their members
outside the node's largest component with all others of the node, so no pair of a node stays uncompared.

Defined results: texts of fewer words than a shingle are one shingle of all their words; null, empty
and wordless texts have an empty set and are linked with nothing; rows with one id are one document, and one without an id is always kept;
ties go to the smallest id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, empty, prepare, stash, tasks, tidy, whole_groups
from .words import Words, grams, mix, slices

TREES, POOL, DEPTH, SMALL = 16, 64, 28, 1024
#: Chance at most with which a pair at the threshold agrees in too few sketch bytes to be a candidate.
MISS = 1e-6
FILTER_BITS = 26
#: About what a task gets: places in leaves, of some 100 bytes each, and bytes of full sets.
LEAF_ROWS, SET_BYTES = 500_000, 64 << 20
#: A large node that has STUCK times in a row kept SHRINKS of its parent's members isn't branched further.
STUCK, SHRINKS = 3, 0.95

_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLIERS = _RNG.integers(1, 1 << 63, POOL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: By tree the order of coordinates: its own first two, then the others.
_ORDER = np.array([[2 * r, 2 * r + 1, *_RNG.permutation([c for c in range(POOL) if c // 2 != r])] for r in range(TREES)])


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lowered."""
    out = []
    for i, j in slices(column):
        w = Words(column.slice(i, j - i), lower=True)
        h = grams(w.hash, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            out.append(np.unique(h[a : b - n + 1]) if b - a >= n else grams(w.hash[a:b], b - a) if b > a else h[:0])
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix(s * np.uint64(m)).sum(dtype=np.uint64).astype(np.int64)) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """POOL minwise values of each set that isn't empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat((flat * m) >> np.uint64(32), at) for m in _MULTIPLIERS], 1).astype(np.uint32)


def _signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                sets = shingle_sets(part.column(1), n)
                digests = [set_digest(s) for s in sets]
                full = [k for k, s in enumerate(sets) if len(s)]
                vec: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, v in zip(full, minima([sets[k] for k in full])):
                        vec[k] = v.tobytes()
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array(vec, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "vec"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, vec binary")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, POOL)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, vec) to (key, tree, class): the first node in each tree."""
    for b in batches:
        v = _vectors(b.column(1)).astype(np.uint64)
        for r in range(TREES):
            x, y = _ORDER[r, :2]
            key = mix(mix((v[:, x] << np.uint64(32) | v[:, y]) + np.uint64(r)) + np.uint64(r))
            yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(np.full(len(v), r, np.int32)), b.column(0)], ["key", "tree", "rep"])


def _branches(level: int, spread: float):
    """(key, tree, class, vec, size, same) to the children of each node: one coordinate, and a second with chance ``spread``. Children keep their parent's size and how often it had not shrunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, key = _vectors(b.column(3)).astype(np.uint64), b.column(0).to_numpy().astype(np.uint64)
            order = _ORDER[b.column(1).to_numpy()]
            for k in (0, 1):
                at = np.arange(len(v)) if k == 0 else np.flatnonzero((mix(key + np.uint64(level)) >> np.uint64(11)).astype(float) / (1 << 53) < spread)
                step = v[at, order[at, 2 + 2 * level + k]]
                child = mix(key[at] * np.uint64(0x9E3779B97F4A7C15) + mix(step * np.uint64(2) + np.uint64(k)))
                yield pa.record_batch([pa.array(child.astype(np.int64)), *(b.column(c).take(pa.array(at)) for c in (1, 2, 4, 5))], ["key", "tree", "rep", "parent", "same"])

    return run


def _shared(paths: DataFrame) -> DataFrame:
    """Paths with the size of their node, without those that are alone."""
    return paths.join(paths.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components: labels sink along pairs and then along themselves."""
    low = np.arange(n)
    x, y = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def least_agreement(percent: int) -> int:
    """Of POOL sketch bytes so many agree in a candidate pair: the most with which a pair at the threshold falls short with chance MISS at most, by the binomial tail."""
    p, k, tail = percent / 100, 0, 0.0
    while k < POOL:
        tail += math.comb(POOL, k) * p**k * (1 - p) ** (POOL - k)
        if tail > MISS:
            break
        k += 1
    return k


def _clusters(percent: int):
    """Rows (key, class, size, sketch) sorted by key and class, to clusters (cluster, class, size, sum of the cluster's sizes) of candidates. With a fifth column, pairs that are equal there are no candidates."""

    agree = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_groups(batches):
            rep, size = b.column(1).to_numpy(), b.column(2).to_numpy()
            sketch = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, POOL)
            part = b.column(4).to_numpy() if b.num_columns > 4 else None
            out: list[tuple[np.ndarray, ...]] = []
            lengths = np.diff(at)
            two = at[:-1][lengths == 2]
            if len(two):
                near = ((sketch[two] == sketch[two + 1]).sum(1) >= agree) & (100 * np.minimum(size[two], size[two + 1]) >= percent * np.maximum(size[two], size[two + 1]))
                if part is not None:
                    near &= part[two] != part[two + 1]
                pair = np.stack([rep[two[near]], rep[two[near] + 1]], 1)
                name = mix(mix(pair[:, 0].astype(np.uint64)) + pair[:, 1].astype(np.uint64))
                out.append((np.repeat(name, 2), pair.ravel(), np.stack([size[two[near]], size[two[near] + 1]], 1).ravel(), np.repeat(size[two[near]] + size[two[near] + 1], 2)))
            for i, j in zip(at[:-1][lengths > 2].tolist(), at[1:][lengths > 2].tolist()):
                s, z = sketch[i:j], size[i:j]
                pairs = [np.stack([np.full(len(y), x), y + x + 1], 1) for x in range(j - i - 1) if len(y := np.flatnonzero(((s[x + 1 :] == s[x]).sum(1) >= agree) & (100 * np.minimum(z[x + 1 :], z[x]) >= percent * np.maximum(z[x + 1 :], z[x]))))]
                if part is not None:
                    g = part[i:j]
                    pairs = [p for pair in pairs if len(p := pair[g[pair[:, 0]] != g[pair[:, 1]]])]
                if not pairs:
                    continue
                low = forest(j - i, np.concatenate(pairs))
                for r in np.unique(low[np.bincount(low, minlength=j - i)[low] > 1]):
                    member = rep[i:j][low == r]
                    name = np.uint64(0)
                    for m in member.astype(np.uint64):
                        name = mix(np.array([name]))[0] + m
                    out.append((np.full(len(member), mix(np.array([name]))[0]), member, z[low == r], np.full(len(member), z[low == r].sum())))
            if out:
                name, *rest = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(name.astype(np.int64)), *map(pa.array, rest)], ["cluster", "rep", "size", "total"])

    return run


def common(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all intersections: products of incidence blocks over tokens that two sets have at least."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    more = count[token] > 1
    token, owner = number[token[more]], owner[more]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, block):
        i, j = np.searchsorted(token, [low, low + block])
        x = np.zeros((len(sets), block), np.float32)
        x[owner[i:j], token[i:j] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _confirmed(percent: int):
    """Rows (cluster, class, set) sorted by cluster and class, to spanning links of the pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in whole_groups(batches):
            rep, data = b.column(1).to_numpy(), b.column(2)
            us, vs = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                one = np.flatnonzero(np.concatenate([[True], rep[i + 1 : j] != rep[i : j - 1]])) + i  # a document may come in several rows
                sets = [np.frombuffer(data[int(k)].as_buffer(), np.uint64) for k in one]
                if len(sets) < 2:
                    continue
                inter, n = common(sets), np.array([len(s) for s in sets])
                x, y = np.nonzero(np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1))
                low = forest(len(sets), np.stack([x, y], 1))
                far = np.flatnonzero(low != np.arange(len(sets)))
                us.append(rep[one[far]])
                vs.append(rep[one[low[far]]])
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def _dealt(clusters: DataFrame, most: int) -> DataFrame:
    """Clusters whose sets have more bytes than ``most`` become pairs of blocks of about half as many, so each pair of members still meets in one cluster."""
    blocks = F.ceil(16 * F.col("total") / most).cast("int")  # a set has 8 bytes a shingle
    rows = clusters.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "cluster"), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> xxhash64(cluster, least(block, o), greatest(block, o)))")
    return rows.select(F.explode(F.when(F.col("total") * 8 <= most, F.array("cluster")).otherwise(pairs)).alias("cluster"), "rep")


def _apart(held: DataFrame, found: DataFrame, small: int) -> DataFrame:
    """Nodes (key, class) that were compared in blocks, to leaves (key, class, component) in which each class outside its node's largest component meets all of the node."""
    named = held.join(found, held.rep == found.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    nodes = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where("size > main.n")
    blocks = lambda n: F.ceil(n * 2 / small).cast("int")
    rows = named.join(nodes.select("key", F.col("main.component").alias("main"), blocks(F.col("main.n")).alias("inner"), blocks(F.col("size") - F.col("main.n")).alias("outer")), "key")
    block = F.pmod(F.xxhash64("rep", "key"), F.when(F.col("component") == F.col("main"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    rows = rows.withColumn("block", block)
    # a leaf is an outer block with an inner one (from -1 down), with itself or with another outer one
    own = F.expr("transform(sequence(0, outer - 1), o -> struct(o AS a, -1 - block AS b))")
    met = F.expr("concat(transform(sequence(0, inner - 1), i -> struct(block AS a, -1 - i AS b)), transform(sequence(0, outer - 1), o -> struct(least(block, o) AS a, greatest(block, o) AS b)))")
    rows = rows.select("key", "rep", "component", F.explode(F.when(F.col("component") == F.col("main"), own).otherwise(met)).alias("leaf"))
    return rows.select(F.xxhash64("key", "leaf.a", "leaf.b").alias("key"), "rep", "component")


def _slot(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64) + np.uint64(11)) >> np.uint64(64 - FILTER_BITS)


def _filter(alive: DataFrame) -> np.ndarray:
    """A bit per hash of a class, 2^FILTER_BITS bits however many there are: texts without one aren't worked on again. A join decides on the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column(0).to_numpy())
            yield pa.record_batch([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).astype(np.int64))], ["word", "bits"])

    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in alive.mapInArrow(tidy(run), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r.word] = r.bits & (1 << 64) - 1
    return out


def _sets(docs: DataFrame, n: int, id_col: str, text_col: str, wanted: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column(0).fill_null(-1).to_numpy())
            b = b.filter(pa.array((wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for i, j in slices(b.column(1)):
                part = b.slice(i, j - i)
                sets = shingle_sets(part.column(1), n)
                digests = [set_digest(s) for s in sets]
                yield pa.record_batch([part.column(0), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "d1", "d2", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "rep long, d1 long, d2 long, tokens binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, depth: int = DEPTH, set_bytes: int = SET_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Documents are linked if 100 * common >= percent * union of their shingle sets."""
    spark = prepare(docs.sparkSession)
    base = stash(_signatures(docs, shingle, id_col, text_col))
    classes = stash(base.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    vectors = stash(base.join(classes, [base.n_shingles == classes.n_shingles, base.d1 == classes.d1, base.d2 == classes.d2, base.doc_id == classes.rep]).select("rep", base.n_shingles, base.d1, base.d2, "vec").dropDuplicates(["rep", "d1", "d2"]))
    level, leaves, held = 0, None, None
    nodes = stash(_shared(vectors.select("rep", "vec").mapInArrow(tidy(_roots), "key long, tree int, rep long")).withColumn("same", F.lit(0)))
    while True:
        large = F.col("size") > small
        stuck = large & ((F.col("same") >= STUCK) | F.lit(level == depth))
        final = nodes.where(~large).select("key", "rep")
        if not empty(nodes.where(stuck)):
            # blocks, each with the node's pivot block
            blocks = F.ceil(F.col("size") * 2 / small).cast("int")
            dealt = nodes.where(stuck).select("key", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep", "key"), blocks).cast("int").alias("block"))
            dealt = dealt.select("key", "rep", F.explode(F.when(F.col("block") > 0, F.array("block")).otherwise(F.expr("sequence(1, blocks - 1)"))).alias("block"))
            final = final.unionByName(dealt.select(F.xxhash64("key", "block").alias("key"), "rep"))
            whole = nodes.where(stuck).select("key", "rep")
            held = whole if held is None else held.unionByName(whole)
        leaves = final if leaves is None else leaves.unionByName(final)
        wide = nodes.where(large & ~stuck)
        if empty(wide):
            break
        children = wide.join(vectors.select("rep", "vec"), "rep").select("key", "tree", "rep", "vec", "size", "same").mapInArrow(tidy(_branches(level, 100 / percent - 1)), "key long, tree int, rep long, parent long, same int")
        same = F.when(F.col("size") >= SHRINKS * F.col("parent"), F.col("same") + 1).otherwise(0)
        nodes = stash(_shared(stash(children)).withColumn("same", same))
        level += 1
    sketch = F.expr(f"unhex(array_join(transform(sequence(1, {4 * POOL}, 4), i -> hex(substring(vec, i, 1))), ''))")

    def links(leaves: DataFrame, *part: str) -> DataFrame:
        rows = leaves.join(vectors.select("rep", "n_shingles", sketch.alias("sketch")), "rep").select("key", "rep", "n_shingles", "sketch", *part)
        clusters = stash(rows.repartition(tasks(spark, leaves.count(), LEAF_ROWS), "key").sortWithinPartitions("key", "rep").mapInArrow(tidy(_clusters(percent)), "cluster long, rep long, size long, total long").distinct())
        alive = clusters.select("rep").distinct()
        sets = stash(_sets(docs, shingle, id_col, text_col, _filter(alive)).join(alive, "rep", "left_semi").join(vectors.select("rep", "d1", "d2"), ["rep", "d1", "d2"], "left_semi").select("rep", "tokens"))
        total, most = (8 * x for x in clusters.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0))).first())
        if most > set_bytes:
            clusters = _dealt(clusters, set_bytes)
        n = tasks(spark, total, SET_BYTES)
        return clusters.join(sets, "rep").select("cluster", "rep", "tokens").repartition(n, "cluster").sortWithinPartitions("cluster", "rep").mapInArrow(tidy(_confirmed(percent)), "u long, v long")

    first = links(leaves)
    if held is None:
        found = components(first)
    else:
        first = stash(first)
        found = components(first)
        rest = stash(_apart(held, found, small))
        if not empty(rest):
            found = components(first.unionByName(links(rest, "component")))
    names = classes.join(found, classes.rep == found.node, "left").select(*(F.col(c).alias(f"c_{c}") for c in ("n_shingles", "d1", "d2")), F.coalesce("component", "rep").alias("component"))
    same = [F.col(c) == F.col(f"c_{c}") for c in ("n_shingles", "d1", "d2")]
    return base.join(names, same, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document has the smallest id of its near-duplicates, with all their columns."""
    found = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(found, docs[options.get("id_col", "doc_id")].cast("long") == found["_kept_id"], "left_semi")
