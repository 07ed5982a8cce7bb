"""Exact n-gram Jaccard join by size-banded tiles.

Every distinct shingle set is one member. Sizes fall into bands so that two linked sets are in the
same or in neighbouring bands. For a pair of bands the hash space is cut into ``m`` ranges; linked
sets differ in at most ``k`` shingles, so at least ``m - k`` ranges are equal, and each set needs to
show only its ``m - e`` best ranges (``e = m - k - 1``) for a shared one to be among them: ranges are
ordered by their content alone, so the best of the equal ranges is shown by both. Good ranges hold many
shingles that are not common in the corpus; a table of fixed size marks common ones, and whatever it
marks no link is lost. Sets that show an equal range fall into one coarse group.

Inside a coarse group, members are laid out by size band and, inside a band, in blocks by hash. A tile is a
pair of blocks of the same or of neighbouring bands; other pairs of bands cannot link and make no tile. In a tile the
members are sorted by size; hashed bitmaps bound each overlap from above (a bit set on one side only is a shingle
the other side lacks) and the pairs left are verified by intersecting the sorted arrays exactly. Every pair of a
coarse group that may link is tested once; a tile returns the number of links of each member and a spanning
forest of them, never all pairs.

Defined results: a null, empty or blank text has an empty set and is linked with nothing; equal sets
(repeated rows too) form one member and are linked with each other; a row without doc_id takes part, and has the
component_id of the others in its class (null if none has a doc_id); an empty table gives an empty result; a
similarity of exactly the threshold links. Very long texts are one set. Columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import MIX, WordHashes, connected_components, cut, hub_links, join_skewed, mix64, runs_in_partition, shingle_hashes, shuffle_width, slices_of, word_hashes, words_of

BLOCK = 256  # members of a block, about; a tile holds two blocks at most
COMMON = 1 << 20  # shingles that count as common, at most; the most frequent ones
COMMON_TEXTS = 8  # different texts of its tasks that hold a common shingle, at least
COMMON_BITS = 24  # the table of common shingles has 2 ** 24 bits
COUNTED = 4_000_000  # shingles that a task counts together
FLUSH_BYTES = 8 << 20  # packed signatures are sent on when they reach this size
BROADCAST_MEMBERS = 200_000  # ids of 8 bytes that may be broadcast; beyond it the join shuffles


class Bands:
    """Size bands for a threshold: band b holds sizes low[b]..high[b], and high[b] / t < low[b + 2]."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.low, self.high = [1], [int(1 / threshold)]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], int(self.low[-1] / self.t)))
        return int(np.searchsorted(np.array(self.high), n))

    def column(self, n: Column) -> Column:
        """The band of a size as a Column."""
        self.of(1 << 31)
        return F.size(F.filter(F.lit(self.high), lambda h: h < n))

    def ranges(self, band: int) -> tuple[int, int]:
        """(m, e) for pairs whose smaller set is in the band."""
        k = int(self.high[band] * (1 - self.t) / self.t)
        e = (k + 1) * 2 // 5
        return k + 1 + e, e


def set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def is_common(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = shingles & np.uint64((1 << COMMON_BITS) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def common_table(hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)
    flags = np.zeros(1 << COMMON_BITS, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little")


def signatures(shingles: np.ndarray, bands: Bands, table: np.ndarray) -> np.ndarray:
    """Hashes of the ranges that a set shows, for its own band and the one below."""
    n = len(shingles)
    rare = np.concatenate([[0], np.cumsum(1 - is_common(shingles, table).astype(np.int64))])
    own = bands.of(n)
    out = []
    for band in (own, own - 1):
        if band < 0 or (band != own and int(bands.high[band] / bands.t) < n):
            continue
        m, e = bands.ranges(band)
        top = shingles >> np.uint64(32)
        cell = ((top * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(cell, minlength=m)
        starts = np.flatnonzero(counts)
        sums = np.zeros(m, np.uint64)
        sums[starts] = np.add.reduceat(mix64(shingles * MIX), (np.cumsum(counts) - counts)[starts])
        ends = np.cumsum(counts)
        good = rare[ends] - rare[ends - counts]
        shown = np.sort(np.lexsort((np.arange(m), counts, good))[e:])
        out.append(mix64(sums[shown] + (shown.astype(np.uint64) << np.uint64(20)) * MIX + np.uint64(band + 1)))
    return np.concatenate(out)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Hashed bitmap of 2 to 4 bits a shingle, as 64-bit words (a power of two of them)."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    flags = np.zeros(bits, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0) if len(words) > size else words


def member_sets(docs: DataFrame, k: int, width: int) -> DataFrame:
    """doc_id, rid, sid (hash of the whole set; null for an empty one), n_shingles; and rows of bucket >= 0 with packed counts
    of the shingles that several different texts of a task hold."""
    def counted(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, n = np.unique(np.concatenate(sets), return_counts=True)
        hashes, n = hashes[n > 1], n[n > 1]
        bucket = (hashes % np.uint64(width)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            own = bucket == b
            yield _member([None], [None], [None], [None], [b], [hashes[own].tobytes() + n[own].astype(np.uint64).tobytes()])

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, held, size = WordHashes(), set(), [], 0
        for batch in (part for whole in batches for part in slices_of(whole)):
            ids, sizes = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(word_hashes(words_of(text), memo), k)
                ids.append(set_id(s) if len(s) else None)
                sizes.append(len(s))
                if len(s) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(s)
                    size += len(s)
                if size > COUNTED:
                    yield from counted(held)
                    seen, held, size = set(), [], 0
            n = len(ids)
            yield _member(batch.column("doc_id"), batch.column("rid"), ids, sizes, [-1] * n, [None] * n)
        if held:
            yield from counted(held)

    return docs.select("doc_id", "rid", "text").mapInArrow(per_batch, "doc_id long, rid long, sid long, n_shingles long, bucket int, counts binary")


def _member(*columns) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("rid", pa.int64()), ("sid", pa.int64()), ("n_shingles", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, kinds)], names=[name for name, _ in kinds])


def common_shingles(counts: DataFrame, width: int) -> np.ndarray:
    """Table of the most frequent shingles, summed by bucket across tasks. counts: bucket, counts."""
    keep = max(1, COMMON // width)

    def add(rows: pa.Table) -> pa.RecordBatch | None:
        parts = [np.frombuffer(c, np.uint64).reshape(2, -1) for c in rows.column("counts").to_pylist()]
        hashes, n = np.concatenate(parts, axis=1)
        order = np.argsort(hashes, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        total, hashes = np.add.reduceat(n[order], at), hashes[order][at]
        chosen = np.flatnonzero(total >= COMMON_TEXTS)
        chosen = chosen[np.lexsort((hashes[chosen], -total[chosen].astype(np.int64)))[:keep]]
        return pa.RecordBatch.from_arrays([pa.array([hashes[chosen].tobytes()], pa.binary())], names=["hashes"]) if len(chosen) else None

    found = [np.frombuffer(r.hashes, np.uint64) for r in runs_in_partition(counts, ["bucket"], add, "hashes binary").collect()]
    return common_table(np.concatenate(found) if found else np.zeros(0, np.uint64))


def coarse_links(docs: DataFrame, k: int, threshold: Fraction, table: np.ndarray, width: int) -> DataFrame:
    """(a, b) set ids: links that connect the sets that show the same range."""

    def send(sigs: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        sig, sid = np.concatenate(sigs), np.concatenate(ids)
        bucket = (sig % np.uint64(width)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(width + 1))
        sig, sid = sig[order], sid[order]
        full = [b for b in range(width) if at[b + 1] > at[b]]
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([sig[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()), pa.array([sid[at[b] : at[b + 1]].tobytes() for b in full], pa.binary())],
            names=["bucket", "sigs", "sids"],
        )

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = WordHashes(), Bands(threshold)
        seen: set[int] = set()  # equal sets of one task show their ranges once
        sigs, ids, held = [], [], 0
        for batch in (part for whole in batches for part in slices_of(whole)):
            for text in batch.column("text").to_pylist():
                s = shingle_hashes(word_hashes(words_of(text), memo), k)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                sigs.append(signatures(s, bands, table))
                ids.append(np.full(len(sigs[-1]), sid, np.int64))
                held += 16 * len(sigs[-1])
                if held > FLUSH_BYTES:
                    yield send(sigs, ids)
                    sigs, ids, held = [], [], 0
        if sigs:
            yield send(sigs, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)) for batch in batches for a, b in zip(batch.column("sigs").to_pylist(), batch.column("sids").to_pylist())]
        if not parts:
            return
        sig, sid = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])])
        links = np.unique(hub_links(sid[once], sig[once]), axis=0)
        for lo in range(0, len(links), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(links[lo : lo + 100_000, 0]), pa.array(links[lo : lo + 100_000, 1])], names=["a", "b"])

    packed = docs.select("text").mapInArrow(show, "bucket int, sigs binary, sids binary")
    return packed.repartition(width, "bucket").mapInArrow(meet, "a long, b long").distinct()


class Tile:
    """Links among the members of a tile; side: the block of each member, all alike for a tile of one block."""

    def __init__(self, sids: np.ndarray, sizes: np.ndarray, copies: np.ndarray, raw: list[bytes], side: np.ndarray, t: Fraction):
        order = np.argsort(sizes, kind="stable")
        self.sids, self.sizes, self.copies, self.side, self.t = sids[order], sizes[order], copies[order], side[order], t
        arrays = [np.frombuffer(raw[i], np.uint64) for i in order]
        self.maps = [bitmap(a) for a in arrays]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        known, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)  # sorted arrays of small numbers
        self.marks = np.zeros(len(known), np.uint8)
        self.folded: dict[int, tuple[int, np.ndarray]] = {}

    def _maps(self, width: int) -> tuple[int, np.ndarray]:
        """First member whose bitmap has the width at least, and the bitmaps from it on, folded to the width."""
        if width not in self.folded:
            first = next(i for i, m in enumerate(self.maps) if len(m) >= width)
            self.folded[width] = first, np.stack([_folded(m, width) for m in self.maps[first:]])
        return self.folded[width]

    def overlaps(self, i: int, others: np.ndarray) -> np.ndarray:
        """Exact sizes of the intersections of one sorted array with others."""
        self.marks[self.flat[self.offsets[i] : self.offsets[i + 1]]] = 1
        lengths = self.sizes[others]
        ends = np.cumsum(lengths)
        if len(others) == others[-1] - others[0] + 1:
            hits = self.marks[self.flat[self.offsets[others[0]] : self.offsets[others[-1] + 1]]]
        else:
            hits = self.marks[self.flat[np.repeat(self.offsets[others] - (ends - lengths), lengths) + np.arange(ends[-1])]]
        self.marks[self.flat[self.offsets[i] : self.offsets[i + 1]]] = 0
        total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
        return total[ends] - total[ends - lengths]

    def links_of(self, i: int) -> np.ndarray:
        """The members after i, in order of size, that link with it."""
        p, q, sizes = self.t.numerator, self.t.denominator, self.sizes
        end = int(np.searchsorted(sizes, sizes[i] * q // p, side="right"))
        if end <= i + 1:
            return np.zeros(0, np.int64)
        first, maps = self._maps(len(self.maps[i]))  # larger bitmaps are folded onto the smaller set's
        mine, theirs = maps[i - first], maps[i + 1 - first : end - first]
        lacks = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
        extra = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
        bound = np.minimum(sizes[i] - lacks, sizes[i + 1 : end] - extra)
        good = (p + q) * bound >= p * (sizes[i] + sizes[i + 1 : end])
        if self.side[0] != self.side[-1] or (self.side != self.side[0]).any():
            good &= self.side[i + 1 : end] != self.side[i]
        others = i + 1 + np.flatnonzero(good)
        if not len(others):
            return others
        both = self.overlaps(i, others)
        return others[q * both >= p * (sizes[i] + sizes[others] - both)]

    def solve(self) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """(forest, links of each member, documents that they stand for)."""
        n = len(self.sids)
        label, forest = np.arange(n), []
        sets, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1):
            js = self.links_of(i)
            if not len(js):
                continue
            sets[i] += len(js)
            sets[js] += 1
            docs[i] += self.copies[js].sum()
            docs[js] += self.copies[i]
            roots, first = np.unique(label[js], return_index=True)
            for root, j in zip(roots.tolist(), js[first].tolist()):
                if root != label[i]:
                    forest.append((int(self.sids[i]), int(self.sids[j])))
                    label[label == root] = label[i]
        return forest, sets, docs


def exact_links(docs: DataFrame, heads: DataFrame, groups: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Verified links inside coarse groups: rows (a, b) of a spanning forest of every tile, and rows (a, null, sets, docs)
    with the number of links of a set in a tile."""
    bands = Bands(threshold)
    placed = groups.withColumnRenamed("node", "sid").join(heads.select("sid", "rid", "n", "copies"), "sid").withColumn("band", bands.column(F.col("n")))
    placed = cut(placed.select("sid", "rid", "label", "n", "copies", "band"))
    sized = placed.groupBy("label", "band").agg(F.count("*").alias("g")).groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("g") / BLOCK).cast("int")))).alias("blocks"))
    wanted = cut(join_skewed(placed, cut(sized), "label"))
    if wanted.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS:
        wanted = F.broadcast(wanted)
    chosen = docs.select("rid", "text").join(wanted, "rid").drop("rid")
    passed = ["sid", "label", "n", "copies", "band"]

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in (part for whole in batches for part in slices_of(whole)):
            sets = [shingle_hashes(word_hashes(words_of(t), memo), k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*passed, "blocks")), pa.array(sets, pa.binary())], names=[*passed, "blocks", "shingles"])

    sets = chosen.select(*passed, "blocks", "text").mapInArrow(arrays, "sid long, label long, n long, copies long, band int, blocks map<int,int>, shingles binary").dropDuplicates(["sid"])
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")[F.col("band")]).cast("int")
    mine = F.struct("band", own.alias("block"))
    near = F.flatten(
        F.transform(
            F.filter(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1), lambda b: F.map_contains_key("blocks", b)),
            lambda b: F.transform(F.sequence(F.lit(0), F.element_at("blocks", b) - 1), lambda block: F.struct(b.alias("band"), block.alias("block"))),
        )
    )
    tiles = sets.withColumn("mine", mine).withColumn("other", F.explode(near))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    tiles = tiles.select("label", low["band"].alias("i"), low["block"].alias("ii"), high["band"].alias("j"), high["block"].alias("jj"), F.xxhash64("mine").alias("side"), "sid", "n", "copies", "shingles")

    def verify(tile: pa.Table) -> pa.RecordBatch | None:
        if tile.num_rows < 2:
            return None
        side, one = tile.column("side").to_numpy(), all(tile.column(a)[0].as_py() == tile.column(b)[0].as_py() for a, b in (("i", "j"), ("ii", "jj")))
        if not one and (side == side[0]).all():
            return None
        work = Tile(tile.column("sid").to_numpy(), tile.column("n").to_numpy(), tile.column("copies").to_numpy(), tile.column("shingles").to_pylist(), side, threshold)
        forest, linked, linked_docs = work.solve()
        at = np.flatnonzero(linked)
        if not len(at):
            return None
        none = [None] * len(at)
        a, b = [x for x, _ in forest] + work.sids[at].tolist(), [x for _, x in forest] + none
        empty = [None] * len(forest)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, empty + linked[at].tolist(), empty + linked_docs[at].tolist())], names=["a", "b", "sets", "docs"])

    return runs_in_partition(tiles, ["label", "i", "ii", "j", "jj"], verify, "a long, b long, sets long, docs long")


def jaccard_components(docs: DataFrame, k: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (documents linked with it), set_links
    (different shingle sets linked with its own), row_hash (of doc_id and text), class_id (a shingle set's hash that names
    the class; null for an empty set)."""
    width = shuffle_width(docs.sparkSession, docs.count())
    docs = docs.select("doc_id", "text").withColumn("rid", F.xxhash64("doc_id", "text"))
    passed = cut(member_sets(docs, k, width))
    members = passed.where("bucket = -1").select("doc_id", "rid", "sid", "n_shingles")
    table = common_shingles(passed.where("bucket >= 0").select("bucket", "counts"), width)
    heads = cut(members.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("head"), F.min("rid").alias("rid"), F.max("n_shingles").alias("n"), F.count("*").alias("copies")))
    groups = connected_components(coarse_links(docs, k, threshold, table, width))
    found = cut(exact_links(docs, heads, groups, k, threshold))
    classes = connected_components(found.where("b is not null").select("a", "b"))
    degrees = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("sets").alias("set_links"), F.sum("docs").alias("doc_links"))
    named = heads.join(classes.select(F.col("node").alias("sid"), "label"), "sid", "left").join(degrees, "sid", "left")
    links = F.col("copies") - 1 + F.coalesce("doc_links", F.lit(0))
    named = cut(named.select("sid", "head", F.coalesce("label", "sid").alias("class"), F.coalesce("set_links", F.lit(0)).alias("set_links"), links.alias("n_links")))
    ids = named.groupBy("class").agg(F.min("head").alias("component_id"))
    by_set = cut(join_skewed(named, cut(ids), "class").select("sid", "component_id", "n_links", "set_links", F.col("class").alias("class_id")))
    out = join_skewed(members, by_set, "sid")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", none).alias("n_links"), F.coalesce("set_links", none).alias("set_links"), F.col("rid").alias("row_hash"), "class_id")


ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^$', ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct r, unnest(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i:i+3], ' '))) as g from d where len(ws) > 0),
n as (select r, count(*) as n from s group by 1),
k as (select r, md5(string_agg(g, chr(10) order by g)) as k from s group by 1),
rep as (select k, min(r) as r, count(*) as copies from k group by 1),
t as (select s.r, s.g from s join rep using (r)),
p as (select a.r as a, b.r as b, count(*) as both_ from t a join t b on a.g = b.g and a.r < b.r group by 1, 2),
l as (select p.a, p.b from p join n x on x.r = p.a join n y on y.r = p.b where 100 * both_ >= 85 * (x.n + y.n - both_)),
e as (select a, b from l union all select b, a from l),
reach as (select r as a, r as b from rep union select reach.a, e.b from reach join e on reach.b = e.a),
o as (select reach.a, min(d.doc_id) as component_id from reach join rep on rep.r = reach.b join k on k.k = rep.k join d on d.r = k.r group by 1),
g as (select e.a, count(*) as set_links, sum(rep.copies) as docs from e join rep on rep.r = e.b group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(o.component_id, d.doc_id) as component_id, coalesce(rep.copies - 1 + coalesce(g.docs, 0), 0)::bigint as n_links, coalesce(g.set_links, 0) as set_links
from d left join n using (r) left join k using (r) left join rep on rep.k = k.k left join o on o.a = rep.r left join g on g.a = rep.r
"""
