"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, also where the driver's path was changed after the session had begun."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="crossgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them again: lineage is cut, a lost executor loses nothing, and later readers see columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all stashed tables of this application; call it when no result of it is still to be read."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What a worker holds between tasks: one large object by name.
_HELD: dict[str, object] = {}


def held(name: str, make):
    """The object of this name that the worker made first; one of another name, an operator's before, goes."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def tidy(fn, holds: str = ""):
    """For mapInArrow: fn, after whose task the worker gives back what memory it no longer uses; what other operators held goes before it begins."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        if holds not in _HELD:
            _HELD.clear()
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def tasks(spark: SparkSession, amount: float, each: float) -> int:
    """Shuffle partitions for an amount of rows or bytes, so that a task gets about ``each`` of them whatever the input; at least as many as the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-int(amount) // int(each)))


def empty(df: DataFrame) -> bool:
    return not df.take(1)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named c0, c1, ..., and these by their names: so no name of an input can clash with one of an operator's own."""
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at


def string_id(c: Column | str) -> Column:
    """The part of a row that has no doc_id: an empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches, key: int = 0):
    """From batches of rows sorted by an integer key column: batches with all rows of their keys, and the positions at which keys begin. Texts and binaries of a group may have over 2 GiB."""
    import numpy as np
    import pyarrow as pa

    rest = []

    def wide(kind):
        return pa.large_string() if pa.types.is_string(kind) else pa.large_binary() if pa.types.is_binary(kind) else kind

    def joined(parts):
        t = pa.Table.from_batches(parts)
        if t.nbytes >= 1 << 30:  # offsets of 32 bits would end a chunk
            t = t.cast(pa.schema([f.with_type(wide(f.type)) for f in t.schema]))
        found = t.combine_chunks().to_batches()
        if len(found) != 1 or found[0].num_rows != t.num_rows:
            raise ValueError(f"a group of {t.num_rows} rows can't be one batch")
        b = found[0]
        k = b.column(key).to_numpy(zero_copy_only=False)
        return b, np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[b.num_rows - 1].as_py()
        if rest and rest[0].column(key)[0].as_py() == last:
            rest.append(b)
            continue
        cut = int(np.searchsorted(k.to_numpy(zero_copy_only=False), last)) if k[0].as_py() != last else 0
        parts, rest = [*rest, *([b.slice(0, cut)] if cut else [])], [b.slice(cut)]
        if parts:
            found = joined(parts)
            del parts, b, k  # what was copied goes before the group is worked on
            yield found
    if rest:
        yield joined(rest)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Rows (node, component): for each end of an edge the smallest node that it reaches. Alternates star contractions towards smaller neighbours until nothing changes; every round is a table in the shared folder, no group is collected."""
    a, b = F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")
    now = stash(edges.select(a, b).where("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stash(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def append(rows: DataFrame, keep: list[str], args: list[Column], fields: list[tuple[str, str, object]], fn, size: int = 1 << 20) -> DataFrame:
    """The columns ``keep`` and new ones that fn gives from the args (Arrow arrays; the first is a text, by whose bytes batches are cut). fields: name, Spark type, Arrow type."""
    import pyarrow as pa

    from .words import slices

    prepare(rows.sparkSession)
    n, many = len(keep), len(args)
    given = rows.select(*keep, *(a.alias(f"_arg{k}") for k, a in enumerate(args)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:n]), *(f"`{name}` {kind}" for name, kind, _ in fields)])

    def run(batches):
        for b in batches:
            for i, j in slices(b.column(n), size):
                part = b.slice(i, j - i)
                new = fn(*(part.column(n + k) for k in range(many)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n)), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(new, fields))], [*part.schema.names[:n], *(f[0] for f in fields)])

    return given.mapInArrow(tidy(run), schema)
