"""Word splitting, hashing and grouped Arrow helpers shared by the llm operators.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; ``bytes.split()`` splits on exactly
those bytes and ``bytes.lower()`` lowers exactly A-Z, so the UTF-8 form gives the contract's words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MEMO_LIMIT = 500_000
BROADCAST_ROWS = 100_000  # rows of a few numbers that may be broadcast
HOT_ROWS = 1_000  # rows of a key that may meet in one task in any case
WIDE_ROWS = 50_000  # rows of a table that a bucket may stand for


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, memoised; forgets everything once it holds _MEMO_LIMIT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words make one whole shingle."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(n if n < k else k), np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : n - width + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


def slices_of(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that only a few texts at a time become Python strings."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df is called so (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    Where the session names none, a temporary folder serves a session whose driver and tasks are one process;
    on a cluster that is an error, as other machines would not see the files.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/docspan-local"


_scratch: list[list[str]] = []  # folders that the open scratch blocks have to delete


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut lineage: write the rows to a table in the shared folder, in folders by a column if asked, and read it back.

    Unlike a checkpoint this also drops the plan's inferred constraints, which grow with every round of
    an iteration. The table goes at the end of the scratch block around it, by release, or when the driver ends.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/docspan-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of cut that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.table_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that cut writes inside, once the block has written its result elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def shuffle_width(spark: SparkSession, rows: int = 0) -> int:
    """Number of buckets: the session's shuffle partitions, more if a bucket would get over WIDE_ROWS of the rows."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), rows // WIDE_ROWS)


def join_skewed(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join of right, which has one row a key, where any key may hold most of left's rows.

    A right side of up to BROADCAST_ROWS rows is broadcast. Beyond it, the keys that hold over a sixteenth of a
    partition's share (so 16 a partition at most) are broadcast, the others shuffled, and null keys are left alone.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "left")
    added = [c for c in right.columns if c != on]
    columns, flag = [*left.columns, *added], free_name(left.join(right, on), "is_hot")
    width = shuffle_width(left.sparkSession)
    share = max(HOT_ROWS, left.count() // (16 * width))
    hot = cut(left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias(flag)).where(F.col(flag) > share).select(on))
    known = cut(right.join(F.broadcast(hot), on, "left_semi").withColumn(flag, F.lit(True)))
    first = left.join(F.broadcast(known), on, "left")
    done = first.where(F.col(flag).isNotNull() | F.col(on).isNull()).select(columns)
    rest = first.where(F.col(flag).isNull() & F.col(on).isNotNull()).select(left.columns)
    return done.unionByName(rest.join(right, on, "left").select(columns))


def runs_in_partition(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Bring rows of equal keys together and call fn once a run.

    One Python call a partition instead of one a group: the rows arrive sorted, and a run that
    spans Arrow batches is carried over.
    """
    width = shuffle_width(df.sparkSession)
    dealt = df.repartition(width, *keys).sortWithinPartitions(*keys)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            bounds = _bounds(table, keys)
            for lo, hi in zip(bounds[:-2], bounds[1:-1]):
                if (out := fn(table.slice(lo, hi - lo))) is not None:
                    yield out
            held = table.slice(bounds[-2]).to_batches()
        if held and (out := fn(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.mapInArrow(per_partition, schema)


def _bounds(table: pa.Table, keys: list[str]) -> list[int]:
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        col = table.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return [*np.flatnonzero(new).tolist(), n]


def hub_links(ids: np.ndarray, group: np.ndarray, fan: int = 64) -> np.ndarray:
    """(n, 2) links that connect the ids of each group; ids and groups are sorted, and no id gets over fan + 1 links a group.

    Each id links to the first of its fan, those to the first of theirs, and so on.
    """
    out = []
    while len(ids):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        head = np.arange(len(ids)) - place % fan
        leaf = place % fan > 0
        if not leaf.any():
            break
        out.append(np.stack([ids[head[leaf]], ids[leaf]], 1))
        ids, group = ids[~leaf], group[~leaf]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label) with the smallest reachable node as label.

    Random-order contraction: each node moves to its neighbour of smallest hash (or stays), links are
    mapped along and those inside a node vanish, so that a few rounds suffice for any shape of graph.
    Nodes and links stay distributed and each round is written to the shared folder. Minima by node
    are partial before the shuffle, so a node with many links costs one row a task.
    """
    links = cut(edges.select("a", "b").where("a <> b").distinct())
    placed: DataFrame | None = None
    turn = 0
    while links.limit(1).count():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("id"))  # noqa: B023, E731
        near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
        moves = cut(near.select(F.col("a").alias("node"), F.least("m", order(F.col("a")))["id"].alias("to")))
        moved = join_skewed(links, moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        moved = join_skewed(moved, moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        before, links = links, cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(before)
        if placed is None:
            placed = moves
        else:
            step = join_skewed(placed, moves.select(F.col("node").alias("to"), F.col("to").alias("on")), "to")
            before, placed = placed, cut(step.select("node", F.coalesce("on", "to").alias("to")))
            release(before, moves)
        turn += 1
    if placed is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return join_skewed(placed, placed.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label")
