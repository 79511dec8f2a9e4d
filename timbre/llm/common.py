"""What several corpus operators share: scratch tables, row keys, components, word arrays.

Scratch tables are Parquet files in the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so that a lost
executor loses nothing that later jobs need.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker tokenises at once; a longer single text is taken alone.
SLICE_BYTES = 1 << 20
#: Bytes up to which a side is broadcast after measuring; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: A key that holds more than this part of all rows is joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; in local mode one is made where the setting is missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    base = "file://" + tempfile.mkdtemp(prefix="timbre-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no plan reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Hold the batches that this session sends to Python workers to ``rows`` rows and ``size`` bytes.

    Texts and packed blocks are wide rows; the default of 10,000 rows would fill a worker.
    """
    for name, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= limit:
            spark.conf.set(key, str(limit))


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(column.getField(f.name), f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 24
    return F.lit(8)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a materialised ``df`` take at most ``limit`` bytes."""
    return (df.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)))).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised ``df`` only when it is small."""
    return F.broadcast(df) if is_small(df, limit) else df


def repeated(df: DataFrame, n: str, number: str, at_once: int = 100_000) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in column ``number``; very many copies are dealt over the tasks in parts."""
    parts = df.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(at_once).cast("long")))).where(F.col(n) > 0)
    if df.where(F.col(n) > at_once).limit(1).count():
        parts = parts.repartition("_first")
    return parts.withColumn(number, F.explode(F.sequence("_first", F.least(n, F.col("_first") + at_once) - 1))).drop("_first")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` with the columns of their group, whatever the size of a group.

    ``groups`` is materialised and has a row for each combination of ``keys`` (none null) that is
    to be met, with its number of rows in column ``n``.  Small tables are broadcast.  Of others, groups of more than ``HOT_SHARE`` of all rows, of which there are
    at most 1 / HOT_SHARE, are marked by a broadcast and their rows spread over salts, by a hash of the row, the same when a lost task
    runs again; the others have the salt 0.
    """
    if is_small(groups):
        return rows.join(F.broadcast(groups), keys)
    total = groups.agg(F.sum(n)).first()[0] or 0
    salts = 64
    least = max(1000, int(total * HOT_SHARE))
    own = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    hot = F.broadcast(groups.where(F.col(n) > least).select(*keys, F.lit(True).alias("_hot")))
    spread = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*own), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    last = F.when(F.col(n) > least, F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")


def row_key(text: str = "text"):
    """A second key beside the id, so that repeated ids with different texts stay apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _joined(batches):
    """Union-find over all edges of one task, labelled by the least node."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kind = None
    for batch in batches:
        kind = batch.schema.field("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = list(parent)
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["node", "comp"])


def connected_components(edges: DataFrame, max_rounds: int = 60, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the least node reachable.

    Edges that take at most ``limit`` bytes, after measuring, are joined in one task.  More of them alternate large-star and small-star contractions.  Minimums are taken by
    ordinary (partially aggregated) groupings and joined back; a hub's edges meet one row, so adaptive
    execution may split them over tasks.  Each round ends in a scratch table, and the one before is deleted.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    cur = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if is_small(cur, limit):
        kind = cur.schema["a"].dataType
        return cur.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("node", kind), T.StructField("comp", kind)]))

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(20,0)"))).first()

    mark = state(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(least, "a")
        nxt = step.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(nxt.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(cur)
        before, mark, cur = mark, state(nxt), nxt
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


# --- word arrays -----------------------------------------------------------------------------


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(start, stop) ranges of rows with about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and len(texts) + 1 offsets."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    words, at = lists.flatten(), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), counts[at - at[0]]


def word_names(words: pa.Array) -> np.ndarray:
    """(words, 2) 64-bit values: the halves of each word's 128-bit xxh3 digest, the same wherever they are computed."""
    if not len(words):
        return np.zeros((0, 2), np.uint64)
    coded = words.dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at = np.frombuffer(at, np.int32)[: len(coded.dictionary) + 1].tolist()
    data, name = data.to_pybytes() if data else b"", xxhash.xxh3_128_digest
    held = np.frombuffer(b"".join([name(data[a:b]) for a, b in zip(at, at[1:], strict=False)]), np.uint64).reshape(-1, 2)
    return held[coded.indices.to_numpy(zero_copy_only=False)]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit value for each word."""
    return word_names(words)[:, 0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_keys(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
