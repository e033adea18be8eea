"""Removal of long repeated byte strings by run-length indexes over anchored shards.

A byte goes if some string of `length` bytes that covers it starts anywhere else in the corpus. Every window of that
length has one anchor, the least of its K-byte hashes (leftmost of equal ones); equal windows have equal anchors. The
windows that share an anchor in one text form a context; contexts of different anchors of a text share no whole window.

1. Count anchors; only texts' contexts at anchors that occur twice go on (most text drops out here).
2. A context that occurs twice is repeated as a whole. It is never compared byte by byte, so copies cost nothing more.
3. The different contexts of an anchor meet in one shard. Each shard builds a run-length BWT index of about SHARD_BYTES
   of contexts, streams all of them through it, and marks the windows whose matching statistics elsewhere in the shard
   reach the length.
4. An anchor with more than HOT different contexts is split into cells, each with its own place among the shards: the
   windows in which the anchor stands at one of CELLS ranges of places share all bytes but that range's width, and those
   bytes are the cell's key. Where more than HOT contexts share even these, their windows themselves are the keys, and
   equal ones are repeated.

Contexts and windows of one key are told apart by bytes (3) or two independent 64-bit hashes (2, and 4's last step; the
anchor's hash and the context's are a pair too), whole texts by another pair. At 10**13 contexts the chance that any two
different ones agree in a pair is below 10**-12. Text is shuffled only for the contexts of steps 3 and 4 and for texts
that lose something. A text is held whole, with about ten words of eight bytes for each of its bytes while it is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import U64, Rolling, bitmap, free, hit_rows, in_bitmap, materialize, mix, ready, spread, steps, text_buffers
from loomspark.llm.runlength_index import RunLengthIndex

LENGTH, K = 400, 128
SHARD_BYTES = 1 << 18
HOT = 500
CELLS = 8
STEP = 1 << 18
BITS = 24


def contexts(data: np.ndarray, off: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, text, first window, last window, anchor) of all contexts of the texts in one buffer.

    Windows and anchors are given by their start inside their text."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.view(U64), empty.view(U64), empty, empty, empty, empty
    roll = Rolling(data)
    kh = roll.kmers(k)
    w = length - k + 1
    low = (kh >> U64(31) << U64(31)) | np.arange(len(kh)).astype(U64)
    size = 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    m = n - length + 1
    low = np.minimum(low[:m], low[w - size : w - size + m])
    pos = (low & U64((1 << 31) - 1)).astype(np.int64)
    # windows that lie inside their text
    count = np.maximum(np.diff(off) - length + 1, 0)
    at = spread(off[:-1], count)
    doc = np.repeat(np.arange(len(count)), count)
    if not len(at):
        return empty.view(U64), empty.view(U64), empty, empty, empty, empty
    p = pos[at]
    new = np.ones(len(at), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, d = at[first], at[last], doc[first]
    return kh[p[first]], roll.of(lo, hi + length), d, lo - off[d], hi - off[d], p[first] - off[d]


class _Scan:
    """Runs over batches of (t1, t2, text), skipping texts that this task met a short time ago."""

    RECENT = 100_000

    def __init__(self, batches):
        self.batches, self.seen = batches, set()

    def steps(self, length: int, k: int):
        for b in self.batches:
            data, off, _ = text_buffers(b.column("text"))
            t1, t2 = b.column("t1").to_numpy(), b.column("t2").to_numpy()
            for i, j in steps(off, STEP):
                got = contexts(data[off[i] : off[j]], off[i : j + 1] - off[i], length, k)
                if len(self.seen) > self.RECENT:
                    self.seen.clear()
                fresh = np.zeros(j - i, bool)
                for x, key in enumerate(zip(t1[i:j].tolist(), t2[i:j].tolist())):
                    if key not in self.seen:
                        self.seen.add(key)
                        fresh[x] = True
                keep = fresh[got[2]] if len(got[2]) else np.zeros(0, bool)
                yield data[off[i] : off[j]], off[i : j + 1] - off[i], t1[i:j], t2[i:j], *(x[keep] for x in got)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == U64 else v) for v in columns.values()], list(columns))


def _anchor_counts(length: int, k: int):
    def run(batches):
        for _, _, _, _, a, *_ in _Scan(batches).steps(length, k):
            if len(a):
                u, n = np.unique(a, return_counts=True)
                yield _batch({"a": u, "n": np.minimum(n, 2).astype(np.int64)})

    return run


def _context_rows(length: int, k: int, wanted):
    """Contexts at anchors of the bitmap. Those met twice in one step are sure to be repeated: their spans go out
    merged (sure), and one row stands for them all with times 2."""

    def run(batches):
        for _, _, t1, t2, a, c, d, lo, hi, _ in _Scan(batches).steps(length, k):
            keep = in_bitmap(wanted.value, a)
            a, c, d, lo, hi = a[keep], c[keep], d[keep], lo[keep], hi[keep]
            if not len(a):
                continue
            order = np.lexsort((c, a))
            new = np.ones(len(a) + 1, bool)
            new[1:-1] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
            twice = np.zeros(len(a), bool)
            twice[order] = ~(new[:-1] & new[1:])
            rep = np.zeros(len(a), bool)
            rep[order[new[:-1]]] = True
            s = np.flatnonzero(twice)
            if len(s):
                s = s[np.lexsort((lo[s], d[s]))]
                far = d[s] * np.int64(1 << 32) + hi[s] + length
                cut = np.ones(len(s), bool)
                cut[1:] = d[s][1:] * np.int64(1 << 32) + lo[s][1:] > np.maximum.accumulate(far)[:-1]
                f = np.flatnonzero(cut)
                end = np.maximum.reduceat(far, f) - d[s][f] * np.int64(1 << 32)
                z = np.zeros(len(f), np.int64)
                yield _batch({"a": z, "c": z, "t1": t1[d[s][f]], "t2": t2[d[s][f]], "lo": lo[s][f], "end": end, "n": z})
            yield _batch({"a": a[rep], "c": c[rep], "t1": t1[d[rep]], "t2": t2[d[rep]], "lo": lo[rep], "end": hi[rep] + length, "n": np.where(twice[rep], 2, 1)})

    return run


def _context_bytes(length: int, k: int, wanted):
    """(a, c, mid, body) of the contexts whose hash is in the bitmap, each once a task or a little more often."""

    def run(batches):
        sent: set[int] = set()
        for data, off, _, _, a, c, d, lo, hi, mid in _Scan(batches).steps(length, k):
            keep = np.flatnonzero(in_bitmap(wanted.value, c))
            if len(sent) > 400_000:
                sent.clear()
            out = []
            for x, key in zip(keep.tolist(), c[keep].tolist()):
                if key not in sent:
                    sent.add(key)
                    out.append(x)
            if out:
                raw = data.tobytes()
                bodies = [raw[i:j] for i, j in zip((off[d[out]] + lo[out]).tolist(), (off[d[out]] + hi[out] + length).tolist())]
                yield _batch({"a": a[out], "c": c[out], "mid": (mid - lo)[out], "body": pa.array(bodies, pa.binary())})

    return run


def _spans(hit: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, start + length) over the sorted window starts."""
    if not len(hit):
        return hit, hit
    cut = np.flatnonzero(np.diff(hit) > length)
    return hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])] + length


def _shard_marks(length: int):
    """Rows sorted by anchor; whole anchors are gathered up to SHARD_BYTES, indexed, and their long matches marked."""

    def index(rows):
        x = RunLengthIndex([r[4] for r in rows])
        hit = np.flatnonzero(x.statistics() >= length)
        own = x.owner[hit]
        out = []
        for i in np.unique(own).tolist():
            s, e = _spans(hit[own == i] - x.starts[i], length)
            out += [(rows[i][1], rows[i][2], rows[i][3] + p, rows[i][3] + q) for p, q in zip(s.tolist(), e.tolist())]
        if out:
            yield _batch(dict(zip(("t1", "t2", "lo", "end"), (np.array(v, np.int64) for v in zip(*out)))))

    def run(batches):
        rows, size, anchor = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("a", "t1", "t2", "lo", "body"))):
                if r[0] != anchor and size >= SHARD_BYTES:
                    yield from index(rows)
                    rows, size = [], 0
                anchor = r[0]
                rows.append(r)
                size += len(r[4])
        if rows:
            yield from index(rows)

    return run


def _cell_rows(length: int, k: int):
    """(cell, t1, t2, lo, body): the windows of each context, by the range that the anchor's place in them is in."""

    def run(batches):
        width = -(-(length - k + 1) // CELLS)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                s = b.slice(at, 2000)
                data, off, _ = text_buffers(s.column("body"))
                raw, roll, mid = data.tobytes(), Rolling(data), s.column("mid").to_numpy()
                a, lo, most = s.column("a").to_numpy(), s.column("lo").to_numpy(), np.diff(off) - length
                for t in range(CELLS):
                    first, last = np.maximum(mid - (t + 1) * width + 1, 0), np.minimum(mid - t * width, most)
                    r = np.flatnonzero(first <= last)
                    if len(r):
                        shared = off[r] + mid[r]
                        key = mix(mix(a[r].view(U64) + U64(t + 1)) + roll.of(shared - t * width, shared - (t + 1) * width + 1 + length))
                        bodies = [raw[i:j] for i, j in zip((off[r] + first[r]).tolist(), (off[r] + last[r] + length).tolist())]
                        yield _batch({"a": key, "t1": s.column("t1").to_numpy()[r], "t2": s.column("t2").to_numpy()[r], "lo": (lo + first)[r], "body": pa.array(bodies, pa.binary())})

    return run


def _window_rows(length: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                data, off, _ = text_buffers(s.column("body"))
                count = np.diff(off) - length + 1
                p = spread(off[:-1], count)
                raw, h = data.tobytes(), xxhash.xxh3_64_intdigest
                d = np.repeat(np.arange(s.num_rows), count)
                second = np.array([h(raw[i : i + length]) for i in p.tolist()], U64)
                lo = s.column("lo").to_numpy()[d] + p - off[d]
                yield _batch({"w1": Rolling(data).of(p, p + length), "w2": second, "t1": s.column("t1").to_numpy()[d], "t2": s.column("t2").to_numpy()[d], "lo": lo})

    return run


def marks(texts: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """(t1, t2, lo, end): byte ranges that repeated windows cover, of every text of texts (t1, t2, text)."""
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("text") >= length)
    counts = texts.mapInArrow(_anchor_counts(length, k), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").select("a")
    counts = materialize(counts, "anchors")
    wanted = spark.sparkContext.broadcast(bitmap(counts, "a", BITS))
    rows = materialize(texts.mapInArrow(_context_rows(length, k, wanted), "a long, c long, t1 long, t2 long, lo long, end long, n long"), "contexts")
    sure = rows.where("n = 0").select("t1", "t2", "lo", "end")
    rows = rows.where("n > 0").join(counts, "a")
    rows = materialize(rows, "repeated")
    by_context = materialize(rows.groupBy("a", "c").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "lo")).alias("rep")), "groups")
    whole = rows.join(by_context.where("n > 1").select("a", "c"), ["a", "c"], "left_semi").select("t1", "t2", "lo", "end")
    kinds = materialize(by_context.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    meet = materialize(by_context.join(kinds, "a").select("a", "c", "rep.*", "kinds"), "meet")
    needed = spark.sparkContext.broadcast(bitmap(meet, "c", BITS))
    bodies = texts.mapInArrow(_context_bytes(length, k, needed), "a long, c long, mid long, body binary")
    ship = materialize(bodies.join(meet, ["a", "c"]).dropDuplicates(["a", "c"]), "bodies")
    shape = "a long, t1 long, t2 long, lo long, body binary"
    cells = materialize(ship.where(F.col("kinds") > hot).mapInArrow(_cell_rows(length, k), shape), "cells")
    sizes = materialize(cells.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    cells = cells.join(sizes, "a")
    cold = ship.where(F.col("kinds") <= hot).select("a", "t1", "t2", "lo", "body").unionByName(cells.where(F.col("kinds") <= hot).drop("kinds"))
    found = cold.repartition("a").sortWithinPartitions("a").mapInArrow(_shard_marks(length), "t1 long, t2 long, lo long, end long")
    windows = cells.where(F.col("kinds") > hot).select("t1", "t2", "lo", "body").mapInArrow(_window_rows(length), "w1 long, w2 long, t1 long, t2 long, lo long")
    windows = materialize(windows, "windows")
    again = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again")
    split = windows.join(again, ["w1", "w2"]).select("t1", "t2", "lo", (F.col("lo") + length).alias("end"))
    return sure.unionByName(whole).unionByName(found).unionByName(split)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """docs plus n_bytes, n_removed, n_spans (long), kept (binary: the remaining bytes) and kept_sha256.

    Null texts are empty. Texts shorter than `length` lose nothing. Rows are known by their text alone: a null or
    repeated doc_id doesn't matter, and every row of a text that occurs twice loses all of it, if it is long enough.
    Columns named like the added ones are replaced, all others come back as they are; an empty table gives an empty
    result."""
    ready(docs.sparkSession)
    if length < 16:
        raise ValueError("length must be 16 or more")
    k = min(k, length // 2)
    new = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    names = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t1, t2, whole_text, los, ends, every = free([*names, *new], "t1", "t2", "text", "lo", "end", "all")
    original = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(*original, F.xxhash64(text).alias(t1), F.xxhash64(F.lit(7), text).alias(t2), text.alias(whole_text))
    long_enough = keyed.where(F.octet_length(whole_text) >= length).select(t1, t2)
    copies = materialize(long_enough.groupBy(t1, t2).agg(F.count("*").alias("times")).where("times > 1").select(t1, t2), "copies")
    found = marks(keyed.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.col(whole_text).alias("text")), length, k, hot)
    spans = found.groupBy(F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_set(F.struct("lo", "end")).alias("s"))
    none = F.array().cast("array<long>")
    touched = copies.select(t1, t2, none.alias(los), none.alias(ends), F.lit(True).alias(every)).unionByName(
        spans.join(copies, [t1, t2], "left_anti").select(t1, t2, F.col("s.lo").alias(los), F.col("s.end").alias(ends), F.lit(False).alias(every)))
    touched = materialize(touched, "touched")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(touched, t1, BITS))

    zero = F.lit(0).cast("long")
    size = F.octet_length(whole_text).cast("long")
    rest = hit_rows(keyed, t1, bits, False).select(*original, size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col(whole_text).cast("binary").alias("kept"), F.sha2(whole_text, 256).alias("kept_sha256"))
    lost = hit_rows(keyed, t1, bits, True).join(touched, [t1, t2], "left").select(*original, whole_text, los, ends, every)
    schema = rest.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for full in batches:
            for at in range(0, full.num_rows, 256):
                b = full.slice(at, 256)
                n, removed, count, kept, sha = [], [], [], [], []
                data, off, _ = text_buffers(b.column(whole_text))
                raw = data.tobytes()
                for i, j, lo, end, everything in zip(off[:-1].tolist(), off[1:].tolist(), *(b.column(c).to_pylist() for c in (los, ends, every))):
                    t = raw[i:j]
                    runs = [(0, len(t))] if everything else merged(lo, end) if lo else []
                    parts, last = [], 0
                    for p, q in runs:
                        parts.append(t[last:p])
                        last = q
                    parts.append(t[last:])
                    left = b"".join(parts)
                    n.append(len(t))
                    removed.append(len(t) - len(left))
                    count.append(len(runs))
                    kept.append(left)
                    sha.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())], schema.names)

    return rest.unionByName(lost.mapInArrow(cut, schema))
