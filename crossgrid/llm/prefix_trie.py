"""Prefix trie of conversations, rolled up by pointer jumping.

A turn becomes a 122-bit digest of its role and text; a prefix, the sum of its turns' digests times powers of
two bases, modulo 2^61 - 1 each. Such digests can be put together: a prefix of two pieces follows from
those of the pieces, so a long conversation is digested in parts, and one that begins
with turns of another needs no second walk. Equal prefixes are one node; a node's key is its digest, and its edge leads to the digest of
the prefix that is one turn shorter.

Sums over subtrees come by doubling: before round k a node knows the sum over its descendants less than 2^k levels below and the ancestor 2^k
levels above. It adds its sum to that ancestor's and takes the ancestor's own pointer. A trie of depth D is done after
log2(D) + 1 rounds, and a round handles only nodes of depth 2^k or more.

Scale: texts are digested where they are read and never move. Turns are dealt by ranges of (conversation, turn), so that a conversation
as long as the table is spread over tasks; members of a node are counted before a shuffle; joins go from many rows to one by the digest, so Spark
may split a hot side. Ids of conversations that end at one node are put together, in order, as pieces of text of PIECE bytes, and its
digest, which can only be taken in order, reads these.

Defined results: rows without a conversation's id are no conversation; a null role or text is empty; turns are ordered by their number, null first, and those of one number by their digest;
repeated rows are turns of their own; the family of a negative id is that of SQL's remainder; an empty table has no nodes; other columns are not read. Digests collide with chance depth * nodes^2 / 2^122.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stash, tasks, tidy

MODULUS = (1 << 61) - 1
#: Two fixed bases of the prefix digests.
BASES = (1_164_379_021_357_844_773, 2_000_690_129_411_562_207)
#: Turns that begin another conversation, at most; conversations that may begin with the same ones.
SHARED, FAMILY = 5, 100
#: Turns of a range; bytes of a piece of joined ids.
RANGE, PIECE = 500_000, 1 << 16

_P, _LOW = np.uint64(MODULUS), np.uint64((1 << 31) - 1)
_TABLES: dict[int, np.ndarray] = {}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    mid = a1 * b0 + a0 * b1
    # 2^62 is 2 and 2^61 is 1 here, so high * 2^62 folds to 2 high and mid * 2^31 to its upper bits and 2^31 times its lower 30
    s = ((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    return np.remainder(s, _P)


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base^n by squares; n may be negative."""
    out = np.ones(len(n), np.uint64)
    for sign, b in ((1, base), (-1, pow(base, -1, MODULUS))):
        left, square = np.maximum(sign * n, 0), b
        while left.any():
            out = np.where(left & 1, times(out, np.uint64(square)), out)
            left, square = left >> 1, square * square % MODULUS
    return out


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums modulo 2^61 - 1, of up to 2^32 values: by halves."""
    low, high = np.cumsum(values & _LOW, dtype=np.uint64), np.cumsum(values >> np.uint64(31), dtype=np.uint64) % _P
    return (low + times(high, np.full(len(high), 1 << 31, np.uint64))) % _P


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + (_P - b)) % _P


def _halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below the modulus, and above zero, from each digest of 16 bytes."""
    words = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)
    return tuple(words[:, k] % (_P - np.uint64(1)) + np.uint64(1) for k in (0, 1))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, digest, chars) in order to (part, conv, at, t1, t2, s1, s2, chars): places from 1 and running digests of a conversation inside its range."""
    part, conv, count, carry = TaskContext.get().partitionId(), None, 0, [0, 0]
    for b in batches:
        c = b.column(0).to_numpy()
        if not len(c):
            continue
        head = np.concatenate([[True], c[1:] != c[:-1]])
        begin = np.maximum.accumulate(np.where(head, np.arange(len(c)), 0))
        goes_on = conv is not None and c[0] == conv
        at = np.arange(len(c)) - begin + 1 + np.where((begin == 0) & goes_on, count, 0)
        out = []
        for k, t in enumerate(_halves(b.column(2))):
            run = sums(times(t, powers(BASES[k], at)))
            s = _minus(run, np.where(begin > 0, run[begin - 1], np.uint64(0)))
            out.append(np.where((begin == 0) & goes_on, (s + np.uint64(carry[k])) % _P, s))
            out.append(t)
        s1, t1, s2, t2 = out
        conv, count, carry = c[-1], int(at[-1]), [int(s1[-1]), int(s2[-1])]
        yield pa.record_batch([pa.array(np.full(len(c), part, np.int32)), b.column(0), pa.array(at), *(pa.array(x.astype(np.int64)) for x in (t1, t2, s1, s2)), b.column(3)], ["part", "conv", "at", "t1", "t2", "s1", "s2", "chars"])


def _placed(before: dict[tuple[int, int], tuple[int, int, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges to (conv, at, before and after each turn the prefix's digests, chars), by what stands before in earlier ranges."""
    for b in batches:
        c, at = b.column(1).to_numpy(), b.column(2).to_numpy()
        ago = np.zeros((len(c), 3), np.int64)
        if before:
            part = b.column(0).to_numpy()
            for conv, p in {*zip(c[(some := np.isin(c, [x for x, _ in before]))].tolist(), part[some].tolist())} & before.keys():
                ago[(c == conv) & (part == p)] = before[conv, p]
        at = at + ago[:, 0]
        out = []
        for k in (0, 1):
            t, s = (b.column(x + k).to_numpy().astype(np.uint64) for x in (3, 5))
            after = (ago[:, 1 + k].astype(np.uint64) + times(s, powers(BASES[k], ago[:, 0]))) % _P
            out += [_minus(after, times(t, powers(BASES[k], at))), after]
        yield pa.record_batch([b.column(1), pa.array(at), *(pa.array(x.astype(np.int64)) for x in (out[0], out[2], out[1], out[3])), b.column(7)], ["conv", "at", "b1", "b2", "a1", "a2", "chars"])


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, at, b1, b2, a1, a2, chars): each turn's place from 1, the digests of the prefixes before and after it, and its code points."""
    spark = prepare(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    sorted_ = rows.repartitionByRange(tasks(spark, turns.count(), RANGE), *order).sortWithinPartitions(*order)
    ranges = stash(sorted_.mapInArrow(tidy(_ranges), "part int, conv long, at long, t1 long, t2 long, s1 long, s2 long, chars long"))
    # two conversations a range, its first and its last, can go on in another: as many rows as ranges, whatever the input
    segments = ranges.groupBy("conv", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("s1", "s2"), "at").alias("s"))
    cut = segments.groupBy("conv").agg(F.count("*").alias("parts"), F.min("part").alias("a"), F.max("part").alias("z")).where("parts > 1").select("conv")
    before: dict[tuple[int, int], tuple[int, int, int]] = {}
    now: dict[int, tuple[int, int, int]] = {}
    for r in sorted(segments.join(cut, "conv").collect(), key=lambda r: (r.conv, r.part)):
        n, s1, s2 = before[r.conv, r.part] = now.get(r.conv, (0, 0, 0))
        now[r.conv] = n + r.n, *((s + v * pow(base, n, MODULUS)) % MODULUS for s, v, base in zip((s1, s2), (r.s.s1, r.s.s2), BASES))
    return ranges.mapInArrow(tidy(partial(_placed, before)), "conv long, at long, b1 long, b2 long, a1 long, a2 long, chars long")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns, with what their conversation leaves out (skip, c1, c2) and begins with (lead, l1, l2), to nodes: their digests are moved from one beginning to the other."""
    for b in batches:
        at, skip, lead = (b.column(k).to_numpy() for k in (1, 7, 10))
        keys = []
        for col, k in ((4, 0), (5, 1), (2, 0), (3, 1)):
            own, left, begin = (b.column(x).to_numpy().astype(np.uint64) for x in (col, 8 + k, 11 + k))
            keys.append((begin + times(_minus(own, left), powers(BASES[k], lead - skip))) % _P)
        yield pa.record_batch([*(pa.array(x.astype(np.int64)) for x in keys), pa.array(lead + at - skip), b.column(0), b.column(6), pa.array(at == b.column(13).to_numpy())], ["k1", "k2", "p1", "p2", "depth", "conv", "chars", "ends"])


def members(turns: DataFrame, shared: Column | None = None, **columns: str) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv, chars, ends): for each conversation, rebuilt, the nodes that it is a member of, from the root (0, 0); ``ends`` at its last.

    A conversation c begins with the first ``shared`` turns (SHARED at most) of conversation c - c % FAMILY, and goes on with its own after as many; by default it is not rebuilt."""
    rows = stash(prefixes(turns, **columns))
    first = [F.max(F.when(F.col("at") == k, F.struct("a1", "a2", "chars"))).alias(f"h{k}") for k in range(1, SHARED + 1)]
    heads = rows.groupBy("conv").agg(F.max("at").alias("n"), F.array(*first).alias("heads"))
    heads = heads.withColumn("h", shared if shared is not None else F.lit(0)).withColumn("skip", F.least("h", "n"))
    base = heads.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads")).where(F.col("base") % FAMILY == 0)
    plan = heads.join(base, F.col("conv") - F.col("conv") % FAMILY == F.col("base"), "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    at = lambda a, k, field: F.when(k > 0, F.get(a, (k - 1).cast("int"))[field]).otherwise(0)
    plan = stash(
        plan.select(
            "conv", "n", F.col("skip").cast("long").alias("skip"), at(F.col("heads"), F.col("skip"), "a1").alias("c1"), at(F.col("heads"), F.col("skip"), "a2").alias("c2"),
            F.col("lead").cast("long").alias("lead"), at(F.col("base_heads"), F.col("lead"), "a1").alias("l1"), at(F.col("base_heads"), F.col("lead"), "a2").alias("l2"),
            F.when(F.col("lead") > 0, F.slice("base_heads", F.lit(1), F.col("lead").cast("int"))).alias("begin"),
        )
    )
    zero = F.lit(0).cast("long")
    total = F.col("lead") + F.col("n") - F.col("skip")
    root = plan.select(zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("depth"), "conv", zero.alias("chars"), (total == 0).alias("ends"))
    led = plan.select("conv", total.alias("total"), "begin", F.posexplode("begin").alias("i", "x"))
    led = led.select(F.col("x.a1").alias("k1"), F.col("x.a2").alias("k2"), at(F.col("begin"), F.col("i"), "a1").alias("p1"), at(F.col("begin"), F.col("i"), "a2").alias("p2"), (F.col("i") + 1).cast("long").alias("depth"), "conv", F.col("x.chars").alias("chars"), (F.col("i") + 1 == F.col("total")).alias("ends"))
    own = rows.join(plan.drop("begin").withColumnRenamed("conv", "_c"), (F.col("conv") == F.col("_c")) & (F.col("at") > F.col("skip")))
    own = own.select("conv", "at", "b1", "b2", "a1", "a2", "chars", "skip", "c1", "c2", "lead", "l1", "l2", "n")
    own = own.mapInArrow(tidy(_rebuilt), "k1 long, k2 long, p1 long, p2 long, depth long, conv long, chars long, ends boolean")
    return root.unionByName(led).unionByName(own)


def roll_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, *values): sums of the values over each node's subtree. nodes: (k1, k2, p1, p2, depth, *values), a null parent for roots."""
    active = stash(nodes.where("depth > 0").select("k1", "k2", F.col("p1").alias("u1"), F.col("p2").alias("u2"), "depth", *values))
    parts = [nodes.select("k1", "k2", *values)]
    top = active.agg(F.max("depth")).first()[0] or 0
    for k in range(top.bit_length()):
        gains = stash(active.groupBy(F.col("u1").alias("g1"), F.col("u2").alias("g2")).agg(*(F.sum(v).alias(f"more_{v}") for v in values)))
        parts.append(gains.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), *(F.col(f"more_{v}").alias(v) for v in values)))
        if 2 << k <= top:
            above = active.select(F.col("k1").alias("v1"), F.col("k2").alias("v2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"))
            left = active.where(F.col("depth") >= 2 << k)
            left = left.join(gains, (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")), "left")
            left = left.join(above, (F.col("u1") == F.col("v1")) & (F.col("u2") == F.col("v2")))
            active = stash(left.select("k1", "k2", F.col("w1").alias("u1"), F.col("w2").alias("u2"), "depth", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("k1", "k2").agg(*(F.sum(v).alias(v) for v in values))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, conv) in order to (k1, k2, least, ids): pieces of joined ids, each with its least."""
    key, ids, size = None, [], 0

    def row():
        return pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["k1", "k2", "least", "ids"])

    for b in batches:
        for k1, k2, conv in zip(*(c.to_pylist() for c in b.columns)):
            if key != (k1, k2) or size >= PIECE:
                if ids:
                    yield row()
                key, ids, size = (k1, k2), [], 0
            ids.append(conv)
            size += 20
    if ids:
        yield row()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (k1, k2, ends_sha256); a piece is hashed as it passes."""
    import hashlib

    key, h = None, None
    for b in batches:
        done = []
        for k1, k2, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
            if key != (k1, k2):
                if key:
                    done.append((*key, h.hexdigest()))
                key, h = (k1, k2), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
    if key:
        yield pa.record_batch([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([h.hexdigest()])], ["k1", "k2", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the SHA-256 of the ids of the conversations that end at each node, ascending, joined by commas."""
    spark, order = rows.sparkSession, ["k1", "k2", "conv"]
    given = rows.where("ends").select(*order)
    pieces = given.repartitionByRange(tasks(spark, given.count(), RANGE), *order).sortWithinPartitions(*order).mapInArrow(tidy(_joined), "k1 long, k2 long, least long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "least").mapInArrow(tidy(_digested), "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, shared: Column | None = None, **columns: str) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stash(members(turns, shared, **columns))
    nodes = stash(rows.groupBy("k1", "k2").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")))
    kids = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = stash(nodes.join(kids, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")))
    whole = roll_up(nodes, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(whole, ["k1", "k2"]).join(ends(rows), ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def shared_turns(conv: Column | str = "conv") -> Column:
    """How many turns a conversation takes from the one that begins its family: CRC-32 of its id as text, modulo SHARED + 1."""
    return F.crc32((F.col(conv) if isinstance(conv, str) else conv).cast("string").cast("binary")) % (SHARED + 1)


def trie_report(conversations: DataFrame) -> DataFrame:
    return trie(conversations, shared_turns())
