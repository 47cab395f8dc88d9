"""Near-duplicate classes by ProbMinHash, banding and verification.

A document's word shingles weigh 1 + RISE * (1 - 1 / count). Each shingle is a Poisson process whose
arrivals, at a rate of its weight, fall on registers at random; a register keeps the shingle that
arrives first. Two documents agree in a register with the probability Jaccard similarity of their
weights. Arrivals are drawn in rounds for whole batches of documents, and a shingle drops out as
soon as its last arrival is later than the first arrivals of all of the document's registers. The
weights lie so close together that documents whose sets of shingles have a Jaccard similarity of 0.8
have a probability Jaccard of 0.78 at least, however often a passage is repeated in one of them: one sketch
finds pairs that are alike by either measure.

Documents with equal shingle counts are one node from the start, so that copies make no pairs.
Nodes that agree in all registers of a band meet in its bucket. There each is compared with the
bucket's least and greatest node, which links most copies. Buckets whose nodes are still in
several components are gone through in tiles of bounded size: every node outside the bucket's
largest component is compared with every node of another component by their registers, of which the
nodes of such buckets get four times as many, and only pairs that look similar leave the tile. A link needs a similarity of 0.8 or more, computed from the
two documents' shingles themselves: of the sets (Jaccard) or of the weights (probability Jaccard),
whichever is greater.

Defined cases: null and empty texts have no shingles and are classes of their own; fewer words
than a shingle's make one shingle of all of them; rows that share a doc_id are one document and
one class, which is linked to all that any of the rows is linked to; rows without a doc_id are not
linked and have a null class; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import cut, small_side, trim
from .components import components

WORDS, SIMILARITY = 5, 0.8
#: What a shingle's weight gains at most by being repeated in its document.
RISE = 0.05
#: Registers of 16 bits. The first 80 make 20 bands of 4: a pair misses all bands with a probability
#: of 0.00003 at a probability Jaccard of 0.8, and of 0.0001 at 0.78.
REGISTERS, BANDS, ROWS = 384, 20, 4
#: Pairs that agree in less of these registers are not compared exactly. At 0.78 that misses a pair with a
#: probability below 1e-5.
LEAST_AGREEMENT = 0.65
#: Further registers, of 8 bits, for nodes that are compared in tiles, and the agreement in all registers
#: that lets a pair out of its tile. At 0.8 that misses a pair with a probability of 1e-6, at 0.78 of 0.002; a large group of
#: documents with similarities of 0.6 to 0.7 leaves next to no pairs.
MORE_REGISTERS, TILE_AGREEMENT = 1152, 0.75
#: Nodes on a side of a tile, about.
TILE = 1024
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + RISE * (1.0 - 1.0 / counts)


def registers(h: np.ndarray, rows: np.ndarray, weight: np.ndarray, n_rows: int, k: int, seed: int = 0) -> np.ndarray:
    """ProbMinHash of every row: (n_rows, k) uint64, the winning shingle of each register.

    h, rows, weight: distinct shingles, in order of their rows.
    """
    first = np.full(n_rows * k, np.inf)
    winner = np.zeros(n_rows * k, _U)
    base = rows.astype(np.int64) * k
    state, clock, w, home, own = h ^ _U(seed), np.zeros(len(h)), weight, base, h
    while len(state):
        state = state + _STEP
        draw = sh.mix(state)
        clock = clock - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / w
        slot = home + (sh.mix(draw ^ _U(0xD6E8FEB86659FD93)) % _U(k)).astype(np.int64)
        np.minimum.at(first, slot, clock)
        won = first[slot] == clock
        winner[slot[won]] = own[won]
        last = first.reshape(n_rows, k).max(axis=1)
        live = clock < last[home // k]
        state, clock, w, home, own = state[live], clock[live], w[live], home[live], own[live]
    return winner.reshape(n_rows, k)


def _content(h: np.ndarray, rows: np.ndarray, counts: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell documents with different shingle counts apart."""
    one, two = np.zeros(n_rows, _U), np.zeros(n_rows, _U)
    np.add.at(one, rows, sh.mix(h + counts.astype(_U) * _STEP))
    np.add.at(two, rows, sh.mix(h * _U(0xC2B2AE3D27D4EB4F) + counts.astype(_U)))
    return one.view(np.int64), two.view(np.int64)


def _sketch(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, ends, data in sh.chunks(batch.column("text")):
                count = len(ends) - 1
                h, rows, counts = sh.distinct(*sh.shingles(ends, data, n))
                packed = (registers(h, rows, weights(counts), count, k) >> _U(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, count), pa.array(np.bincount(rows, minlength=count), pa.int64()), *map(pa.array, _content(h, rows, counts, count)),
                    pa.array([x.tobytes() for x in packed], pa.binary()),
                ], names=["doc_id", "shingles", "c1", "c2", "registers"])
        trim()

    return run


def _more_registers(n: int, k: int):
    """The low bytes of k further registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, ends, data in sh.chunks(batch.column("text")):
                count = len(ends) - 1
                h, rows, counts = sh.distinct(*sh.shingles(ends, data, n))
                low = registers(h, rows, weights(counts), count, k, 0xA0761D6478BD642F).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids.slice(row, count), *map(pa.array, _content(h, rows, counts, count)), pa.array([x.tobytes() for x in low], pa.binary())], names=["node", "c1", "c2", "more"])
        trim()

    return run


def _contents(n: int):
    """The shingles of documents and their counts, sorted by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for row, ends, data in sh.chunks(batch.column("text")):
                count = len(ends) - 1
                h, rows, counts = sh.distinct(*sh.shingles(ends, data, n))
                cuts = np.searchsorted(rows, np.arange(1, count))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, count), *map(pa.array, _content(h, rows, counts, count)),
                    pa.array([x.tobytes() for x in np.split(h, cuts)], pa.binary()),
                    pa.array([x.tobytes() for x in np.split(counts.astype("<u4"), cuts)], pa.binary()),
                ], names=["node", "c1", "c2", "h", "n"])
        trim()

    return run


def _agree(k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, k) for c in ("ra", "rb"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) > least))

    return run


def _tiles(k: int, more: int, bands: int, rows: int, first: float, least: float):
    """Rows (key, i, j, side, band, part, node, registers, more) in order of (key, i, j): compares the
    nodes of side 0 with those of side 1 that are in another part, unless the two have met in an
    earlier band, and keeps the pairs that agree in enough registers: first of those that all nodes
    have, then of all."""

    def compare(band: int, side: np.ndarray, part: np.ndarray, node: np.ndarray, reg: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        key = np.ascontiguousarray(reg[:, : bands * rows]).reshape(len(reg), bands, rows)
        step = max(1, (1 << 22) // max(1, len(y) * 8))
        for at in range(0, len(x), step):
            own = x[at : at + step]
            fresh = part[own][:, None] != part[y][None, :]
            for t in range(band):
                fresh &= (key[own, t][:, None] != key[y, t][None, :]).any(axis=2)
            i, j = np.nonzero(fresh)
            for f in range(0, len(i), 1 << 14):
                p, q = own[i[f : f + (1 << 14)]], y[j[f : f + (1 << 14)]]
                same = (reg[p] == reg[q]).sum(axis=1)
                like = same > first * k
                p, q, same = p[like], q[like], same[like]
                like = same + (low[p] == low[q]).sum(axis=1) > least * (k + more)
                a.append(node[p[like]])
                b.append(node[q[like]])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, side, band, part, node = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "band", "part", "node"))
            reg = np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(-1, k)
            low = np.frombuffer(b"".join(t.column("more").to_pylist()), np.uint8).reshape(-1, more)
            new = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            cuts = np.flatnonzero(new) + 1
            found = [compare(int(band[a]), side[a:b], part[a:b], node[a:b], reg[a:b], low[a:b]) for a, b in zip([0, *cuts], [*cuts, len(key)])]
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            whole = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if ((key != key[-1]) | (i != i[-1]) | (j != j[-1])).any() else 0
            if whole:
                yield from pairs(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())
        trim()

    return run


def similarity(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> tuple[float, float]:
    """Jaccard of the sets and probability Jaccard of the weights."""
    if not len(ha) or not len(hb):
        return 0.0, 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(both)
    plain = len(both) / union
    if not len(both):
        return 0.0, 0.0
    wa, wb = weights(na), weights(nb)
    sa, sb = wa[ia], wb[ib]
    rest_a, rest_b = wa.sum() - sa.sum(), wb.sum() - sb.sum()
    if (wa == 1).all() and (wb == 1).all():
        return plain, plain
    # J_P sums, over the shared shingles d, 1 / sum over d' of max(a(d')/a(d), b(d')/b(d)). With the
    # shared ones in order of b/a, the terms with the greater ratio take b, the others a.
    order = np.argsort(sb / sa, kind="stable")
    sa, sb = sa[order], sb[order]
    head_a = np.cumsum(sa)  # d' up to and with d: a(d')/a(d) is the greater
    tail_b = sb.sum() - np.cumsum(sb)
    total = (rest_a + head_a) / sa + (rest_b + tail_b) / sb
    return plain, float((1 / total).sum())


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for ha, na, hb, nb in zip(*(b.column(c) for c in ("ha", "na", "hb", "nb"))):
                x = similarity(*(np.frombuffer(v.as_py(), t) for v, t in ((ha, "<u8"), (na, "<u4"), (hb, "<u8"), (nb, "<u4"))))
                keep.append(max(x) >= least - 1e-12)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _pairs_of(ids: DataFrame, table: DataFrame, prefix: str, columns: dict[str, str]) -> DataFrame:
    side = table.select(F.col("node").alias(prefix), *[F.col(c).alias(x) for c, x in columns.items()])
    return ids.join(side, prefix)


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b), each once; repeats go before the shuffle."""
    return pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()


class NearDuplicates:
    """One run over documents (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.words, self.least, self.bands, self.rows = words, least, bands, rows
        self.k = max(REGISTERS, bands * rows)

    def sketches(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, node) of all rows with an id, and (node, c1, c2, registers) of the nodes with shingles.
        A node is the least doc_id of the documents with the same shingle counts. Registers are
        shuffled only where the groups of equal documents are too many for a broadcast."""
        schema = "doc_id long, shingles long, c1 long, c2 long, registers binary"
        every = cut(self.docs.where("doc_id IS NOT NULL").mapInArrow(_sketch(self.words, self.k), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")
        same = every.where("shingles > 0").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
        many = cut(same.where("copies > 1").select("c1", "c2", F.col("first.doc_id").alias("node"), F.col("first.row").alias("first")), "equal-documents")
        known = every.join(small_side(many, 64), ["c1", "c2"], "left")
        filled = F.col("shingles") > 0
        member = known.select("doc_id", F.when(filled, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node"))
        nodes = known.where(filled & (F.col("first").isNull() | (F.col("first") == F.col("row")))).select(F.coalesce("node", "doc_id").alias("node"), "c1", "c2", "registers")
        return member, cut(nodes, "nodes")

    def band_rows(self, nodes: DataFrame) -> DataFrame:
        """(key, band, node): a node's key in every band."""
        width = 2 * self.rows
        key = lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width)))
        keys = F.transform(F.sequence(F.lit(0), F.lit(self.bands - 1)), lambda i: F.struct(key(i).alias("key"), i.alias("band")))
        return nodes.select(F.explode(keys).alias("k"), "node").select("k.key", "k.band", "node")

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) whose registers agree enough."""
        pairs = cut(pairs, "pairs")
        held = nodes.join(small_side(_ends(pairs), 16, 2 * pairs.count()), "node", "left_semi")
        both = _pairs_of(_pairs_of(pairs, held, "a", {"registers": "ra"}), held, "b", {"registers": "rb"})
        return both.select("a", "b", "ra", "rb").mapInArrow(_agree(self.k, LEAST_AGREEMENT), "a long, b long")

    def verified(self, likely: DataFrame) -> DataFrame:
        """The links (u, v) of a written table of pairs (a, b): those whose shingles are similar enough."""
        ids = small_side(_ends(likely).withColumnRenamed("node", "doc_id"), 16, 2 * likely.count())
        own = self.docs.join(ids, "doc_id", "left_semi")
        contents = cut(own.mapInArrow(_contents(self.words), "node long, c1 long, c2 long, h binary, n binary"), "contents")
        if self.shared_ids:  # a document may have several texts, each counts once
            contents = contents.dropDuplicates(["node", "c1", "c2"])
        both = _pairs_of(_pairs_of(likely, contents, "a", {"h": "ha", "n": "na"}), contents, "b", {"h": "hb", "n": "nb"})
        return both.mapInArrow(_verify(self.least), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v"))

    def classes(self) -> DataFrame:
        """doc_id, class_id of every row with an id; class_id is the least doc_id of the class."""
        member, nodes = self.sketches()
        twice = member.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("__most"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
        self.shared_ids = not twice.isEmpty()
        rows = self.band_rows(nodes)
        buckets = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"))
        buckets = cut(buckets.where("lo < hi"), "buckets")
        met = cut(rows.join(small_side(buckets, 40), "key"), "bucket-members")
        ends = F.explode(F.array(F.struct(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")), F.struct(F.least("node", "hi").alias("a"), F.greatest("node", "hi").alias("b"))))
        pairs = met.select(ends.alias("p")).select("p.a", "p.b").where("a < b").distinct()
        likely = self.likely(pairs, nodes)
        links = self.verified(cut(likely.distinct() if self.shared_ids else likely, "likely-pairs"))
        if self.shared_ids:  # the nodes of one document are one class
            several = twice.where("v < __most").select("doc_id", "v")
            links = links.unionByName(member.join(several, "doc_id").select(F.col("node").alias("u"), "v").where("u != v").distinct())
        roots = components(links)
        more = cut(self.across(met.where("size > 2"), roots, nodes), "pairs-across")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(self.verified(more)))
        return member.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class_id"))

    def across(self, met: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
        """Likely pairs of nodes that share a bucket but no component. A bucket of two has had its
        one comparison; nodes inside a bucket's largest component need none with each other."""
        placed = met.join(roots, "node", "left").select("key", "band", "node", "size", F.coalesce("root", "node").alias("part"))
        parts = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
        mixed = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"), F.max("size").alias("size")).where("top.n < size")
        tiles = lambda n: F.ceil(n / TILE).cast("int")
        mixed = cut(mixed.select("key", F.col("top.part").alias("major"), tiles(F.col("size") - F.col("top.n")).alias("ni"), tiles(F.col("size")).alias("nj")), "mixed-buckets")
        placed = cut(placed.join(small_side(mixed, 32), "key").drop("size"), "mixed-members")
        spot = F.xxhash64("node")
        few = placed.where("part != major").select("key", "band", "part", "node", F.pmod(spot, "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), F.lit(0).alias("side"))
        all_ = placed.select("key", "band", "part", "node", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(spot, "nj").cast("int").alias("j"), F.lit(1).alias("side"))
        ids = small_side(placed.select("node").distinct(), 16)
        own = self.docs.join(ids.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
        more = own.mapInArrow(_more_registers(self.words, MORE_REGISTERS), "node long, c1 long, c2 long, more binary")
        if self.shared_ids:
            more = more.dropDuplicates(["node", "c1", "c2"])
        held = nodes.join(ids, "node", "left_semi").join(more, ["node", "c1", "c2"]).drop("c1", "c2")
        rows = few.unionByName(all_).join(held, "node").select("key", "i", "j", "side", "band", "part", "node", "registers", "more")
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return rows.mapInArrow(_tiles(self.k, MORE_REGISTERS, self.bands, self.rows, LEAST_AGREEMENT, TILE_AGREEMENT), "a long, b long").distinct()


def classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id of every document; null for a row without doc_id."""
    found = NearDuplicates(docs, **settings).classes()
    none = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.unionByName(none)


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs without the documents whose class has one with a smaller doc_id."""
    found = classes(docs, **settings).where("doc_id != class_id").select("doc_id").distinct()
    dropped = cut(found, "near-copies")
    return docs.join(small_side(dropped, 16), "doc_id", "left_anti").select(*docs.columns)
