"""Removal of repeated substrings: suffix arrays over shards of the places that can repeat.

Every 200-byte string (window) is owned by one anchor, the 32-byte gram of smallest hash inside it; equal
windows are owned by equal anchors at the same offset. So only windows of anchors that occur twice can
repeat, and the text is cut into anchor runs (consecutive windows with the same owner). Runs that are equal
as a whole, by a 128-bit hash of their bytes, repeat without further work. The other runs of an anchor that occurs
twice go, with their bytes, to shards by anchor. A shard sorts its suffixes to 200 bytes by Larsson-Sadakane
refinement in numpy (ranks of h bytes refine the groups that are still tied to 2h bytes) and finds the common
prefixes of neighbours by Kasai's rule, in many stretches of the text at once: a suffix shares one byte less with
the suffix before it than its predecessor in the text did. Neighbours that share 200 bytes repeat.
An anchor with many runs is split into several shards. Windows that are not settled inside such a shard, and
one of each kind that is, meet those of the other shards by binary search in sorted 128-bit fingerprints, dealt out
by fingerprint so that no task holds them all.

Defined results: texts are their UTF-8 bytes; null and empty texts have no bytes; texts shorter than a window
lose nothing; repeated rows are documents of their own, and each loses all its bytes if it has 200; a row without
doc_id is a document; an empty table gives no rows; of equal strings (ties) all go, the first too; very long texts
are cut into runs a stretch at a time; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.llm.text import MIX, MIX2, cut, join_skewed, mix64, runs_in_partition, shuffle_width, slices_of

WINDOW = 200
GRAM = 32
STRETCH = 1 << 22  # bytes of a text that are taken up at once
BATCH_BYTES = 8 << 20
SHARD_RUNS = 100  # runs of one anchor in a shard, at most
SHARD_BYTES = 1 << 20  # shards are sorted together up to this size
STEPS = 64  # positions of a stretch in Kasai's rule
ONCE, SAME, DIFFERENT, CHIEF = 1, 2, 3, 4  # how often an anchor or a run occurs; the run that stands for equal ones


def anchor_runs(raw: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of the runs of windows with the same owner."""
    n = len(raw) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = raw.astype(np.uint64) + np.uint64(1)
    power, length = MIX, 1
    while length < gram:
        h = h[:-length] * power + h[length:]
        power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
        length *= 2
    h = mix64(h)
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    grams = window - gram + 1
    low, length = key, 1
    while length * 2 <= grams:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    if grams > length:
        low = np.minimum(low[: len(low) - (grams - length)], low[grams - length :])
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    owner = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    return starts, np.diff(np.append(starts, n)), h[owner]


def text_runs(raw: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor hash, low and high half of the 128-bit hash of the run's bytes) over a whole text."""
    parts, view = [], memoryview(raw)
    for lo in range(0, max(1, len(raw) - window + 1), STRETCH):
        piece = np.frombuffer(view[lo : lo + STRETCH + window - 1], np.uint8)
        starts, counts, anchors = anchor_runs(piece, window, gram)
        ends = starts + counts + window - 1
        digest = xxhash.xxh3_128_digest
        whole = np.frombuffer(b"".join(digest(view[a:b]) for a, b in zip((starts + lo).tolist(), (ends + lo).tolist())), np.uint64).reshape(-1, 2)
        parts.append((starts + lo, counts, anchors, whole[:, 0], whole[:, 1]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts like them (zeros past the end)."""
    k, length = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64), 1
    while length < 8:
        k = (k[:-length] << np.uint64(8 * length)) | k[length:]
        length *= 2
    return k[: len(text)]


def sorted_suffixes(text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All places of the text in the order of their next window bytes (Larsson-Sadakane refinement); ties by place."""
    n = len(text)
    k8 = eight_bytes(text)
    order = np.argsort(k8, kind="stable")
    rank = np.empty(n + window, np.int64)
    rank[n:] = -1
    ordered = k8[order]
    rank[order] = _group_starts(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    h = 8
    sizes = np.bincount(rank[:n], minlength=n)
    while 2 * h <= window:
        tied = np.flatnonzero(sizes[rank[:n]] > 1)
        if not len(tied):
            break
        order = tied[np.argsort((rank[tied] << 32) | (rank[tied + h] + 1), kind="stable")]
        a, b = rank[order], rank[order + h]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new = new_a | np.concatenate([[True], b[1:] != b[:-1]])
        refined = a + _group_starts(new) - _group_starts(new_a)
        rank[order] = refined
        sizes = np.bincount(rank[:n], minlength=n)
        h *= 2
    out = np.empty(n, np.int64)
    alone = sizes[rank[:n]] == 1
    out[rank[:n][alone]] = np.flatnonzero(alone)
    tied = np.flatnonzero(~alone)
    if len(tied):
        tied = tied[np.argsort((rank[tied] << 32) | (rank[tied + window - h] + 1), kind="stable")]
        a = rank[tied]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        out[a + np.arange(len(tied)) - _group_starts(new)] = tied
    return out


def _group_starts(new: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(new)
    return at[np.cumsum(new) - 1]


_BYTE = [np.uint64(1 << 8 * i) for i in range(1, 8)]


def kasai(k8: np.ndarray, order: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Common prefix of each place with the one before it in order, up to window bytes, by place.

    Kasai's rule: if place i shares h bytes with the place p before it, then i + 1 shares h - 1 with p + 1, and with
    all that lies between them in the order, if p + 1 comes before i + 1 (which ties beyond the window can turn
    round; then the prefix is measured anew). Stretches of STEPS places go through the text side by side.
    """
    n = len(order)
    place = np.empty(n + 1, np.int64)
    place[order], place[n] = np.arange(n), n
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([k8, np.zeros(window + 8, np.uint64)])
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, STEPS)
    h, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1, np.int64)
    for step in range(STEPS):
        i = lanes + step
        if i[-1] >= n:  # only the last stretch can be shorter
            lanes, i, h, last = lanes[:-1], i[:-1], h[:-1], last[:-1]
            if not len(i):
                break
        p = before[i]
        follows = (last >= 0) & (place[last + 1] < place[i])
        h = np.where(follows & (p >= 0), np.maximum(h - 1, 0), 0)
        limit = np.where(p >= 0, np.minimum(window, n - np.maximum(i, p)), 0)
        active = np.flatnonzero(h < limit)
        while len(active):
            reach = h[active]
            differ = padded[i[active] + reach] ^ padded[p[active] + reach]
            same = differ == 0
            ended = differ[~same]
            h[active[~same]] += 7 - sum((ended >= b).astype(np.int64) for b in _BYTE)
            h[active[same]] += 8
            active = active[same & (h[active] < limit[active])]
        h = np.minimum(h, limit)
        out[i] = h
        last = p
    return out


def fingerprints(k8: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(2, n): low and high half of 128-bit hashes of windows, from two chains of multiplications."""
    low, high = np.full(len(starts), np.uint64(window)), np.full(len(starts), ~np.uint64(window))
    for at in [*range(0, window - 8, 8), window - 8]:
        part = k8[starts + at]
        low = (low ^ part) * MIX
        low ^= low >> np.uint64(29)
        high = (high + part) * MIX2
        high ^= high >> np.uint64(32)
    return np.stack([mix64(low), mix64(high)])


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=n * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


_ASK = "batch long, bucket int, kind int, data binary, counts binary"


def _ask(batch: int, bucket: int, kind: int, data: bytes, counts: bytes) -> pa.RecordBatch:
    return _batch({"batch": ([batch], pa.int64()), "bucket": ([bucket], pa.int32()), "kind": ([kind], pa.int32()), "data": ([data], pa.binary()), "counts": ([counts], pa.binary())})


def _places(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed runs of repeated windows) of each document."""
    order = np.lexsort((starts, keys))
    keys, starts, counts = keys[order], starts[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() if len(keys) else []
    for lo, hi in zip(at, [*at[1:], len(keys)]):
        yield int(keys[lo]), np.stack([starts[lo:hi], counts[lo:hi]]).astype(np.int64).tobytes()


_PLACES = "key long, runs binary"


def _place_batch(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return _batch({"key": ([k for k, _ in found], pa.int64()), "runs": ([r for _, r in found], pa.binary())})


def repeated_places(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, runs: (first window, number) of repeated windows, by document key; a key may have several rows. docs: key, text."""
    width = shuffle_width(docs.sparkSession, docs.count())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ordinal = TaskContext.get().partitionId(), 0

        def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal ordinal
            batch, ordinal = task << 24 | ordinal, ordinal + 1
            keys = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            starts, counts, anchors, whole, half = (np.concatenate(x) for x in list(zip(*held))[1:])
            refs = []
            for kind, hashes, other in ((0, anchors, whole), (1, mix64(anchors * MIX + whole), half)):
                by = np.lexsort((other, hashes))
                new = np.concatenate([[True], hashes[by][1:] != hashes[by][:-1]])
                if kind == 1:  # runs are equal if both halves are
                    new[1:] |= other[by][1:] != other[by][:-1]
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(by)))
                low, high = other[by][at], other[by][at + n - 1]
                distinct = hashes[by][at]
                ref = np.empty(len(by), np.int64)
                ref[by] = np.repeat(np.arange(len(at)), n)
                codes = np.where(n == 1, ONCE, np.where(low == high, SAME, DIFFERENT)).astype(np.uint8)
                bucket = (distinct % np.uint64(width)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                refs.append(place[ref])
                bounds = np.searchsorted(bucket[order], np.arange(width + 1))
                for b in range(width):
                    own = order[bounds[b] : bounds[b + 1]]
                    if len(own):
                        yield _ask(batch, b, kind, np.concatenate([distinct[own], low[own]]).tobytes(), codes[own].tobytes())
            # refs rise and fall with hashes, so they take their bytes; starts and counts compress
            head = [keys.tobytes(), starts.astype(np.int64).tobytes(), counts.astype(np.int64).tobytes(), refs[0].astype(np.int64).tobytes(), refs[1].astype(np.int64).tobytes(), anchors.tobytes()]
            yield _ask(batch, -1, -1, _pack(np.frombuffer(b"".join(head), np.int64)), b"")

        held, size = [], 0
        for batch in (part for whole in batches for part in slices_of(whole)):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                held.append((key, *text_runs(raw, window, gram)))
                size += len(raw)
                if size > BATCH_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(b, k, kind, np.frombuffer(d, np.uint64), np.frombuffer(c, np.uint8)) for part in batches for b, k, kind, d, c in zip(*(part.column(c).to_pylist() for c in ("batch", "bucket", "kind", "data", "counts")))]
        for kind in (0, 1):
            mine = sorted((x for x in asked if x[2] == kind), key=lambda x: x[0])
            if not mine:
                continue
            sizes = [len(x[4]) for x in mine]
            hashes, runs = (np.concatenate([x[3][lo * n : (lo + 1) * n] for x, n in zip(mine, sizes)]) for lo in (0, 1))
            codes = np.concatenate([x[4] for x in mine])
            order = np.lexsort((np.arange(len(hashes)), runs, hashes))
            new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            if kind == 1:
                new[1:] |= runs[order][1:] != runs[order][:-1]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            code = np.maximum.reduceat(codes[order], at)
            code = np.where(n > 1, np.maximum(code, SAME), code)
            if kind == 0:
                code = np.where(runs[order][at] != runs[order][at + n - 1], DIFFERENT, code)
            reply = np.empty(len(order), np.uint8)
            reply[order] = np.repeat(code, n)
            if kind == 1:  # the first batch that has the run stands for it
                chief = order[at][code == SAME]
                reply[chief] = CHIEF
            lo = 0
            for (batch, bucket, *_), size in zip(mine, sizes):
                yield _ask(batch, bucket, kind, b"", reply[lo : lo + size].tobytes())
                lo += size

    def settle(rows: pa.Table) -> pa.RecordBatch | None:
        """Runs that repeat as a whole, and one of each kind of run of the anchors whose runs differ."""
        table = rows.select(["kind", "bucket", "data", "counts"]).to_pylist()
        flat = _unpack(next(r["data"] for r in table if r["kind"] == -1), np.int64)
        keys, starts, counts, anchor_ref, run_ref, anchors = flat.reshape(6, -1)
        if not len(keys):
            return None
        replies = [np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in sorted((r for r in table if r["kind"] == kind), key=lambda r: r["bucket"])]) for kind in (0, 1)]
        several, same = replies[0][anchor_ref] == DIFFERENT, replies[1][run_ref]
        whole = same > ONCE
        chief = np.zeros(len(keys), bool)
        first = np.unique(run_ref, return_index=True)[1]
        chief[first] = same[first] == CHIEF
        part = several & (~whole | chief)
        done = dict(_places(keys[whole], starts[whole], counts[whole]))
        order = np.flatnonzero(part)
        order = order[np.lexsort((starts[order], keys[order]))]
        k = keys[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])).tolist() if len(k) else []
        open_ = {int(k[lo]): np.stack([starts[order[lo:hi]], counts[order[lo:hi]], anchors[order[lo:hi]]]).tobytes() for lo, hi in zip(at, [*at[1:], len(k)])}
        names = sorted(done.keys() | open_.keys())
        return _batch({"key": (names, pa.int64()), "runs": ([done.get(x) for x in names], pa.binary()), "open": ([open_.get(x) for x in names], pa.binary())}) if names else None

    scanned = cut(docs.mapInArrow(scan, _ASK))
    replies = scanned.where("bucket >= 0").repartition(width, "bucket").mapInArrow(meet, _ASK)
    settled = cut(runs_in_partition(scanned.where("bucket = -1").union(replies), ["batch"], settle, "key long, runs binary, open binary"))
    open_runs = settled.where("open is not null").select(F.col("key").alias("k"), "open").dropDuplicates(["k"])
    return settled.where("runs is not null").select("key", "runs").union(shared_windows(docs, open_runs, window))


def shared_windows(docs: DataFrame, open_runs: DataFrame, window: int) -> DataFrame:
    """key, runs of the windows in open runs (k, open) that repeat in another run of the same anchor."""
    width = shuffle_width(docs.sparkSession, docs.count())
    joined = docs.join(open_runs, F.col("key") == F.col("k"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            rows: list[tuple] = []
            for key, text, data in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "open"))):
                raw = text.encode("utf-8", "surrogatepass")
                starts, counts, anchors = np.frombuffer(data, np.int64).reshape(3, -1)
                rows += [(a, key, s, n, raw[s : s + n + window - 1]) for s, n, a in zip(starts.tolist(), counts.tolist(), anchors.tolist())]
                if len(rows) > 20_000:
                    yield _runs_batch(rows)
                    rows = []
            if rows:
                yield _runs_batch(rows)

    runs = joined.select("key", "text", "open").mapInArrow(extract, "anchor long, key long, start long, n long, bytes binary")
    runs = cut(runs)
    large = runs.groupBy("anchor").agg(F.count("*").alias("times")).where(F.col("times") > SHARD_RUNS).select("anchor", F.ceil(F.col("times") / SHARD_RUNS).cast("int").alias("shards"))
    dealt = join_skewed(runs, cut(large), "anchor").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod(F.xxhash64("key", "start"), F.col("shards")).cast("int"))
    dealt = dealt.select("anchor", "shard", "shards", "key", "start", "n", "bytes").repartition(width, "anchor", "shard").sortWithinPartitions("anchor", "shard")

    def sort_shard(rows: dict[str, np.ndarray | list]) -> Iterator[pa.RecordBatch]:
        raw = rows["bytes"]
        text = np.frombuffer(b"".join(raw), np.uint8)
        n = rows["n"]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])[:-1]])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        run = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(run)) - first[run]
        starts = offsets[run] + within
        k8 = eight_bytes(text)
        of = np.full(len(text), -1, np.int64)
        of[starts] = np.arange(len(starts))
        order = sorted_suffixes(text, window)
        kind = np.cumsum(kasai(k8, order, window)[order] < window)  # equal windows are of one kind
        window_of = of[order]
        kind, window_of = kind[window_of >= 0], window_of[window_of >= 0]  # places near the end of a run start no window
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(kind)))
        repeated = np.zeros(len(starts), bool)
        repeated[window_of[np.repeat(size > 1, size)]] = True
        found = list(_places(*_consecutive(rows["key"][run[repeated]], rows["start"][run[repeated]] + within[repeated])))
        for lo in range(0, len(found), 5_000):
            part = found[lo : lo + 5_000]
            yield _batch({"key": ([k for k, _ in part], pa.int64()), "runs": ([r for _, r in part], pa.binary()), "bucket": ([-1] * len(part), pa.int32()), "data": ([None] * len(part), pa.binary())})
        # of split anchors, one window of each kind meets the other shards
        kind_first = np.zeros(len(starts), bool)
        kind_first[window_of[new]] = True
        away = np.flatnonzero(kind_first & (rows["shards"][run] > 1))
        if not len(away):
            return
        prints = fingerprints(k8, starts[away], window)
        bucket = (prints[0] % np.uint64(width)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        away, prints = away[order], prints[:, order].view(np.int64)
        bounds = np.searchsorted(bucket[order], np.arange(width + 1))
        for b in range(width):
            own = away[bounds[b] : bounds[b + 1]]
            if len(own):
                data = [*prints[:, bounds[b] : bounds[b + 1]], rows["key"][run[own]], rows["start"][run[own]] + within[own], repeated[own].astype(np.int64)]
                yield _batch({"key": ([0], pa.int64()), "runs": ([None], pa.binary()), "bucket": ([b], pa.int32()), "data": ([_pack(np.concatenate(data))], pa.binary())})

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def columns(table: pa.Table) -> dict:
            return {c: table.column(c).to_pylist() if c == "bytes" else table.column(c).to_numpy() for c in ("anchor", "shard", "shards", "key", "start", "n", "bytes")}

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < SHARD_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor, shard = table.column("anchor").to_numpy(), table.column("shard").to_numpy()
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (shard[1:] != shard[:-1])) + 1
            if not len(new):
                continue
            # whole shards up to about SHARD_BYTES at a time
            sizes = np.cumsum([len(x) for x in table.column("bytes").to_pylist()])
            lo = 0
            for hi in new.tolist():
                if sizes[hi - 1] - (sizes[lo - 1] if lo else 0) >= SHARD_BYTES or hi == new[-1]:
                    yield from sort_shard(columns(table.slice(lo, hi - lo)))
                    lo = hi
            held = table.slice(lo).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield from sort_shard(columns(pa.Table.from_batches(held)))

    sorted_ = cut(dealt.mapInArrow(sort_shards, "key long, runs binary, bucket int, data binary"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(d, np.int64).reshape(5, -1) for batch in batches for d in batch.column("data").to_pylist()]
        if not parts:
            return
        low, high, keys, starts, known = np.concatenate(parts, axis=1)
        order = np.lexsort((high, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
        numbers = np.cumsum(new)  # sorted; a fingerprint is one number
        prints = np.empty(len(order), np.int64)
        prints[order] = numbers
        times = np.searchsorted(numbers, prints, side="right") - np.searchsorted(numbers, prints, side="left")
        new = (times > 1) & (known == 0)
        found = list(_places(*_consecutive(keys[new], starts[new])))
        if found:
            yield _place_batch(found)

    across = sorted_.where("bucket >= 0").select("bucket", "data").repartition(width, "bucket").mapInArrow(merge, _PLACES)
    return sorted_.where("bucket = -1").select("key", "runs").union(across)


def _runs_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return _batch({name: (list(c), pa.binary() if name == "bytes" else pa.int64()) for name, c in zip(("anchor", "key", "start", "n", "bytes"), cols)})


def _consecutive(keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents as runs (key, first window, number)."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(keys)) - 1 if len(keys) else at
    return keys[at], starts[at], starts[last] - starts[at] + 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) of every text."""
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    places = repeated_places(keyed.where("text is not null").select("key", "text"), window, gram)
    by_doc = cut(places.groupBy(F.col("key").alias("k")).agg(F.collect_set("runs").alias("runs")))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices_of(whole)):
            rows: list[tuple] = []
            for doc_id, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs"))):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                spans: list[tuple[int, int]] = []
                if runs:
                    starts, counts = np.concatenate([np.frombuffer(r, np.int64).reshape(2, -1) for r in runs], axis=1)
                    order = np.argsort(starts, kind="stable")
                    starts, ends = starts[order], (starts + counts + window - 1)[order]
                    reach = np.maximum.accumulate(ends)
                    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
                    spans = list(zip(starts[new].tolist(), reach[np.append(new[1:], len(starts)) - 1].tolist()))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield _batch({"doc_id": (list(cols[0]), pa.int64()), "n_bytes": (list(cols[1]), pa.int64()), "n_removed": (list(cols[2]), pa.int64()), "n_spans": (list(cols[3]), pa.int64()), "kept_sha256": (list(cols[4]), pa.string()), "spans": (list(cols[5]), pa.string())})

    joined = keyed.join(by_doc, F.col("key") == F.col("k"), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
