"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Each partition tokenizes its documents, cuts those that are longer than a sequence and packs the
pieces best-fit, longest first. Nearly full bins are final. The others become items of their own
and go up a tree to its root: every node packs the open bins of its children best-fit again. Open
bins of equal fill are alike, so a node needs only how many there are of each fill, CAPACITY numbers
at most; it answers with ranges of ranks, and every open bin finds its place by its rank among those of its
fill. No task holds the open bins of a large node. The pieces stay where they are and learn their
final place from a join on their bin.

Defined cases: a null text is empty, and an empty document is its end token alone; repeated rows
are packed one by one; a null doc_id is kept; an empty table gives no pieces; extra columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, trim
from .mixing import prefix
from .tokens import word_tokenizer

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: A bin with no more free tokens than this is final.
SLACK = 16
#: Children of a tree node.
FAN_IN = 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, open boolean"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Pack items, largest first, each into the fullest bin that takes it.

    Returns each item's bin and offset, and each bin's fill. Free space is a small integer, so the
    bins wait in one stack for each free space, and a bit mask of the stacks in use finds the
    smallest that suffices: O(1) an item.
    """
    bins, at = [0] * len(sizes), [0] * len(sizes)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        fits = used >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                used ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], at[i] = b, fill[b]
        fill[b] += size
        if r > size:
            free[r - size].append(b)
            used |= 1 << (r - size)
    return bins, at, fill


def _pack_partition(tokenizer: str, capacity: int, slack: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer).encode
        end = (0).to_bytes(4, "little")
        docs, pieces, starts, sizes, crcs, ids = [], [], [], [], [], []
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, data in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                data += end
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    docs.append(doc)
                    pieces.append(piece)
                    starts.append(start)
                    sizes.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
        if not docs:
            return
        bins, at, fill = best_fit(sizes, capacity)
        base = TaskContext.get().partitionId() << 32
        columns = [
            pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
            pa.array([base + b for b in bins], pa.int64()), pa.array(at, pa.int64()), pa.array([capacity - fill[b] > slack for b in bins], pa.bool_()),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "open"]
        if keep_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=10_000)
        trim()

    return run


def fit_classes(sizes: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """The packing of ``best_fit`` for many items of few sizes, class by class.

    Returns runs (size, rank, n, bin, at): the n items of that size from rank on go to the n bins from
    bin on, at place at; and runs (bin, n, fill) of all bins.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    used = n_bins = 0

    def put(r: int, first: int, n: int) -> None:
        nonlocal used
        if n:
            free[r].append((first, n))
            used |= 1 << r

    for size, left in sorted(zip(sizes, counts), reverse=True):
        rank = 0
        while left and (fits := used >> size):
            r = size + (fits & -fits).bit_length() - 1
            first, n = free[r].pop()
            if not free[r]:
                used ^= 1 << r
            k = min(n, left)
            runs.append((size, rank, k, first, capacity - r))
            put(r, first + k, n - k)
            put(r - size, first, k)
            rank, left = rank + k, left - k
        if left:  # new bins, each with as many of the size as it takes, and a last one with the rest
            each = capacity // size
            full, rest = divmod(left, each)
            for k in range(each):
                if n := full + (k < rest):
                    runs.append((size, rank, n, n_bins, k * size))
                    rank += n
            put(capacity - each * size, n_bins, full)
            put(capacity - rest * size, n_bins + full, int(rest > 0))
            n_bins += full + (rest > 0)
    return runs, [(first, n, capacity - r) for r, stack in enumerate(free) for first, n in stack]


def _plan(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        """Rows (node, size, n) of one node to runs of items and, with a null size, of bins."""
        node = table.column("node")[0].as_py()
        runs, bins = fit_classes(table.column("size").to_pylist(), table.column("n").to_pylist(), capacity)
        rows = [*runs, *[(None, None, n, first, fill) for first, n, fill in bins]]
        names = ("size", "rank", "n", "first", "at")
        return pa.table({"node": pa.array([node] * len(rows), pa.int64())} | {c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*rows))})

    return run


def merge_tree(open_bins: DataFrame, partitions: int, capacity: int, slack: int) -> DataFrame:
    """(bin, size) of open bins, a bin's partition in its upper half, to (bin, into, shift): where each
    bin's pieces finally are. Bins of the tree's nodes are numbered from (level << 56) | (node << 32)."""
    items = open_bins.select("bin", "size")
    moved, nodes, level = None, partitions, 0
    while True:
        nodes, level = -(-nodes // FAN_IN), level + 1
        part = F.shiftright("bin", 32).bitwiseAND((1 << 24) - 1)
        items = cut(items.select("bin", "size", F.floor(part / FAN_IN).alias("node"), F.spark_partition_id().alias("chunk")), "open-bins")
        plan = items.groupBy("node", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
        plan = cut(plan.applyInArrow(_plan(capacity), "node long, size long, rank long, n long, first long, at long"), "bin-plan")
        ranked = prefix(items.withColumn("key", F.col("node") * (capacity + 1) + F.col("size")), "key", "chunk", F.lit(1).cast("long"), ["bin"])
        runs = plan.where("size IS NOT NULL").select((F.col("node") * (capacity + 1) + F.col("size")).alias("__key"), "rank", "n", "first", "at")
        name = F.lit(level << 56).bitwiseOR(F.shiftleft("node", 32))
        placed = ranked.join(small_side(runs, 64), (F.col("key") == F.col("__key")) & (F.col("before") >= F.col("rank")) & (F.col("before") < F.col("rank") + F.col("n")))
        step = placed.select("bin", name.bitwiseOR(F.col("first") + F.col("before") - F.col("rank")).alias("into"), F.col("at").alias("shift"))
        if moved is None:
            moved = cut(step, "moved-bins")
        else:
            step = cut(step.select(F.col("bin").alias("__bin"), F.col("into").alias("__into"), F.col("shift").alias("__shift")), "moves")
            chain = moved.join(small_side(step, 48), F.col("into") == F.col("__bin"), "left")
            moved = cut(chain.select("bin", F.coalesce("__into", "into").alias("into"), (F.col("shift") + F.coalesce("__shift", F.lit(0))).alias("shift")), "moved-bins")
        if nodes <= 1:
            return moved
        bins = plan.where((F.col("size").isNull()) & (capacity - F.col("at") > slack))
        items = bins.select(name.alias("name"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i"), F.col("at").alias("size")).select(F.col("name").bitwiseOR(F.col("i")).alias("bin"), "size")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, slack: int = SLACK, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    keep_ids the ids themselves (little-endian unsigned 32-bit)."""
    schema = _PIECES + ", ids binary" * keep_ids
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack_partition(tokenizer, capacity, slack, keep_ids), schema)
    pieces = cut(pieces, "pieces")
    heads = pieces.where("open").groupBy("bin").agg(F.sum("length").alias("size"))
    last = pieces.agg(F.max("bin")).first()[0]
    moved = merge_tree(heads, ((last or 0) >> 32) + 1, capacity, slack)
    return pieces.join(small_side(moved, 40), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
        *["ids"] * keep_ids,
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack(..., keep_ids=True)``: sequence_id, tokens and the ids."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", "tokens", ids.alias("ids"))
