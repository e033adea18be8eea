"""Substring dedup by paragraph MinHash banding.

Two kinds of units go into bands of MinHash signatures of their five-word shingles:

* paragraphs, the lines of at least MIN_LINE words: bands tuned for high recall at the threshold find candidates, exact
  Jaccard verifies them, connected components cluster them;
* passages: of every WINDOW neighbouring windows of SEED words, over line ends too, the one of the least hash. The words
  alone choose them, so any SEED + WINDOW - 1 = MIN_RUN words that repeat hold a window that is chosen wherever they
  stand. A window has SEED - 4 shingles, too few to be similar and not equal; so one band finds all pairs, and its key
  takes in the order of the words, for edit distance 0. Clusters are extended word by word, first against the first
  occurrence, then against the first that shares the words beyond it; only runs of at least MIN_RUN words are removed,
  so no window goes by its key alone: as many words again have to agree by hashes of their own. REACH words on each side
  are enough: a match that goes on beyond has a further window.

Of each cluster the occurrence with the least (doc_id, hash of the text, word) stays. Shuffled are hashes, never text;
text moves only for documents that lose something (plus the false hits of a fixed-size bitmap). A band key of more than
BLOCK paragraphs is split: all are compared with one of them, and those unlike it with all others in blocks.

A text is held whole, with some ten words of eight bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, U64, Rolling, _powers, bitmap, free, hit_rows, in_bitmap, materialize, mix, ready, spread, steps, text_buffers, words
from loomspark.operators.components import connected_components
from loomspark.scratch import is_empty, small

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.995
MIN_RUN, MIN_LINE = 20, 20
SEED, WINDOW = 10, 11
REACH = WINDOW - 1
#: Shares of the least hashes in the one band of a window.
SEED_ROWS = 2
#: Paragraphs of one band key that are compared in one task.
BLOCK = 256
#: Stands for a missing doc_id.
LAST = (1 << 63) - 1


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = 24) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands, of `hashes` hashes, still find a pair at the threshold with `recall`."""
    fit = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    if not fit:
        raise ValueError("more hashes are needed for this recall")
    return fit[-1]


class Units:
    """Words, lines and content-chosen windows of the texts in one buffer."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.start, self.end, self.first = words(data, off)
        n = len(self.start)
        self.hash = Rolling(LOWER[data]).of(self.start, self.end) if n else np.zeros(0, U64)
        up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(self.hash * up[:n], out=self.sums[1:])
        breaks = np.cumsum(data == 10)
        new = np.ones(n, bool)
        if n:
            new[1:] = breaks[self.start[1:]] != breaks[self.start[:-1]]
            new[self.first[:-1][self.first[:-1] < n]] = True
        self.line = np.flatnonzero(new)
        self.line_end = np.append(self.line[1:], n) if n else self.line
        self.new = new

    def seq(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hash of the words i .. j - 1."""
        return mix((self.sums[j] - self.sums[i]) * self.down[i] + (j - i).astype(U64))

    def doc(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    def windows(self, width: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """(first word, end word) of the last least-hashed of every `window` neighbouring windows of `width` words."""
        n = len(self.start)
        g = np.zeros(n + 2 * window, U64)  # 0 where no window fits: what stands there bounds every text
        at = np.arange(max(n - width + 1, 0))
        at = at[self.first[self.doc(at) + 1] - at >= width]
        if not len(at):
            return at, at
        g[at + window] = np.maximum(self.seq(at, at + width), U64(1))
        own = g[at + window]
        left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        more, less = np.ones(len(at), bool), np.ones(len(at), bool)
        for d in range(1, window):
            more &= g[at + window - d] >= own
            less &= g[at + window + d] > own
            left += more
            right += less
        at = at[left + right >= window - 1]
        return at, at + width

    def around(self, i: np.ndarray, j: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
        """(words of the text behind j, `reach` at most; 32-bit hashes of the 1 .. reach words before i and behind j)."""
        d = self.doc(i)
        low, high = self.first[d], self.first[d + 1]
        out = np.zeros((len(i), 2 * reach), np.uint32)
        for k in range(1, reach + 1):
            out[:, k - 1] = self.seq(np.maximum(i - k, low), i) >> U64(32)
            out[:, reach + k - 1] = self.seq(j, np.minimum(j + k, high)) >> U64(32)
        return np.minimum(high - j, reach), out

    def shingles(self, i: np.ndarray, j: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, count per unit) of the units' shingles; a unit of fewer words is one shingle."""
        count = np.maximum(j - i - width + 1, 1)
        at = spread(i, count)
        return self.seq(at, np.minimum(at + width, np.repeat(j, count))), count


def _scan(batches, emit):
    """Calls emit(units, d, t) for each step of texts (d, t, text) and passes on the batches it gives."""
    for b in batches:
        data, off, _ = text_buffers(b.column("text"))
        d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
        for i, j in steps(off):
            got = emit(Units(data[off[i] : off[j]], off[i : j + 1] - off[i]), d[i:j], t[i:j])
            if got is not None:
                yield got


def _passage_rows(wanted=None, near=False):
    def emit(u: Units, ids, texts):
        i, j = u.windows()
        if not len(i):
            return None
        h = mix(band_keys(*u.shingles(i, j), 1, SEED_ROWS)[:, 0] + u.seq(i, j))
        if wanted is not None:
            keep = in_bitmap(wanted.value, h)
            i, j, h = i[keep], j[keep], h[keep]
        doc = u.doc(i)
        cols = [pa.array(x) for x in (h.view(np.int64), ids[doc], texts[doc], (i - u.first[doc]).astype(np.int32), (j - i).astype(np.int32))]
        names = ["h", "d", "t", "pos", "n"]
        if near:
            room, sides = u.around(i, j)
            off = pa.py_buffer((np.arange(len(i) + 1) * sides.shape[1] * 4).astype(np.int32))
            cols += [pa.array(room.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(i), [None, off, pa.py_buffer(sides)])]
            names += ["room", "near"]
        return pa.RecordBatch.from_arrays(cols, names)

    return lambda batches: _scan(batches, emit)


def _near(col) -> np.ndarray:
    data, off, _ = text_buffers(col)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(len(off) - 1, 2 * REACH)


def _edges(batches):
    """(h) of the repeated passages within REACH words of an end of a run of them; rows come sorted by d, t, pos."""

    def close(t):
        d, text, pos, n = (t.column(c).to_numpy() for c in ("d", "t", "pos", "n"))
        end = pos.astype(np.int64) + n
        new = np.append(True, (d[1:] != d[:-1]) | (text[1:] != text[:-1]))
        no = np.cumsum(new) - 1
        far = np.maximum.accumulate(end + no * (1 << 33)) - no * (1 << 33)
        new[1:] |= pos[1:] > far[:-1]
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        keep = (pos - pos[at][run] <= REACH) | (np.maximum.reduceat(end, at)[run] - end <= REACH)
        yield pa.RecordBatch.from_arrays([pa.array(t.column("h").to_numpy()[keep])], ["h"])

    return _runs(batches, ["d", "t", "h", "pos", "n"], close)


def _keys(h, code, side, more):
    return mix(mix(h.view(U64) + (side + 1).astype(U64)) + (code.astype(U64) << U64(8)) + more.astype(U64)).view(np.int64)


def _extended(batches):
    """Rows beside their first occurrence: (null, d, t, at, pos, n) with what agrees on both sides of it, and for each
    side that ends before REACH words (key, ..., side, more, h), whose key holds one word more, the more-th."""
    for b in batches:
        if not b.num_rows:
            continue
        h, pos, n, room, first_pos, first_room = (b.column(c).to_numpy() for c in ("h", "pos", "n", "room", "first_pos", "first_room"))
        own, first = _near(b.column("near")), _near(b.column("first_near"))
        length = np.arange(1, REACH + 1)
        start, size, row, side, more, code = pos.copy(), n.copy(), [], [], [], []
        for k, have, both in ((0, np.minimum(pos, REACH), np.minimum(pos, first_pos)), (1, room, np.minimum(room, first_room))):
            x, y = own[:, k * REACH : (k + 1) * REACH], first[:, k * REACH : (k + 1) * REACH]
            same = np.logical_and.accumulate((x == y) & (length <= both[:, None]), axis=1).sum(1).astype(np.int32)
            start -= same if k == 0 else 0
            size += same
            r = np.flatnonzero(same < have)
            row.append(r)
            side.append(np.full(len(r), k, np.int32))
            more.append(same[r] + np.int32(1))
            code.append(x[r, same[r]])
        row, side, more, code = (np.concatenate(x) for x in (row, side, more, code))
        every = np.concatenate([np.arange(len(pos)), row])
        none = np.arange(len(every)) < len(pos)
        wide = lambda x: np.concatenate([np.zeros(len(pos), x.dtype), x])
        key = _keys(h[row], code, side, more)
        yield pa.RecordBatch.from_arrays([pa.array(wide(key), mask=none), b.column("d").take(pa.array(every)), b.column("t").take(pa.array(every)), pa.array(pos[every]), pa.array(np.concatenate([start, pos[row]])), pa.array(np.concatenate([size, n[row]])), pa.array(wide(side)), pa.array(wide(more)), pa.array(h[every])], ["key", "d", "t", "at", "pos", "n", "side", "more", "h"])


def _longer(batches):
    """(key, d, t, at, pos, n) for each longer side of rows whose side is shared by one word more."""
    for b in batches:
        if not b.num_rows:
            continue
        h, pos, n, side, more, room = (b.column(c).to_numpy() for c in ("h", "at", "n", "side", "more", "room"))
        near = _near(b.column("near"))
        have = np.where(side == 0, np.minimum(pos, REACH), room)
        count = (have - more + 1).astype(np.int64)
        r = np.repeat(np.arange(len(pos)), count)
        k = spread(more.astype(np.int64), count).astype(np.int32)
        key = _keys(h[r], near[r, side[r] * REACH + k - 1], side[r], k)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column("d").take(pa.array(r)), b.column("t").take(pa.array(r)), pa.array(pos[r]), pa.array(np.where(side[r] == 0, pos[r] - k, pos[r]).astype(np.int32)), pa.array(n[r] + k)], ["key", "d", "t", "at", "pos", "n"])


def band_keys(sh: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """units x bands keys of the MinHash signatures of shingle hashes."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, bands * rows, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 62, bands * rows, dtype=np.int64).astype(U64)
    at = np.cumsum(count) - count
    out = np.zeros((len(count), bands), U64)
    for k in range(bands):
        key = np.full(len(count), U64(k + 1))
        for r in range(k * rows, (k + 1) * rows):
            v = sh * a[r] + b[r]
            v ^= v >> U64(32)
            key = mix(key * U64(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, at))
        out[:, k] = key
    return out


def _line_units(u: Units, min_words: int):
    keep = u.line_end - u.line >= min_words
    i, j = u.line[keep], u.line_end[keep]
    return i, j, u.seq(i, j)


#: Lines whose hashes a task remembers so as not to send their bands again; only saves work.
RECENT = 200_000


def _band_rows(bands: int, rows: int, min_words: int):
    def run(batches):
        seen: set[int] = set()

        def emit(u: Units, ids, texts):
            i, j, h = _line_units(u, min_words)
            if len(seen) > RECENT:
                seen.clear()
            fresh = []
            for k, x in enumerate(h.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(k)
            i, j, h = i[fresh], j[fresh], h[fresh]
            if not len(i):
                return None
            keys = band_keys(*u.shingles(i, j), bands, rows)
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(h, bands).view(np.int64))], ["key", "unit"])

        yield from _scan(batches, emit)

    return run


def _runs(batches, columns, close):
    """Streams rows sorted by their first column as whole runs: close(list of column arrays of one batch of runs)."""
    rest = None
    for b in batches:
        cols = [b.column(c) for c in columns]
        t = pa.Table.from_arrays(cols, list(columns))
        t = pa.concat_tables([rest, t]) if rest is not None else t
        key = t.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield from close(t.slice(0, cut).combine_chunks())
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield from close(rest.combine_chunks())


def similar_forest(flat: np.ndarray, start: np.ndarray, size: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spanning forest of the links of Jaccard >= threshold among sets, given as runs of distinct hashes.

    Breadth first: a reached set is compared with those not reached yet, so sets of one dense group cost one
    comparison each, and no pair table is made."""
    _, ids = np.unique(flat, return_inverse=True)
    member = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    sets = [ids[s : s + n] for s, n in zip(start.tolist(), size.tolist())]
    left = np.arange(len(start))
    out = []
    while len(left):
        queue = [int(left[0])]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            member[sets[i]] = True
            gathered = np.concatenate([sets[k] for k in left.tolist()])
            n = size[left]
            inter = np.add.reduceat(member[gathered].astype(np.int64), np.cumsum(n) - n)
            member[sets[i]] = False
            hit = inter >= threshold * (n + size[i] - inter) - 1e-9
            for k in left[hit].tolist():
                out.append((i, k))
                queue.append(k)
            left = left[~hit]
        if not len(left):
            break
    return out


def _verified(threshold: float):
    def close(t):
        key, unit = t.column("key").to_numpy(), t.column("unit").to_numpy()
        lists = t.column("shingles").combine_chunks() if isinstance(t.column("shingles"), pa.ChunkedArray) else t.column("shingles")
        off = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy()
        cut = np.flatnonzero(np.diff(key)) + 1
        src, dst = [], []
        # a unit may stand twice under a key of a block
        for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(key)]]).tolist()):
            if b - a > 1:
                s = off[a:b]
                for i, j in similar_forest(flat[s[0] : off[b]], s - s[0], np.diff(off[a : b + 1]), threshold):
                    src.append(unit[a + i])
                    dst.append(unit[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return lambda batches: _runs(batches, ["key", "unit", "shingles"], close)


def _line_rows(wanted, min_words: int):
    def emit(u: Units, ids, texts):
        i, j, h = _line_units(u, min_words)
        keep = in_bitmap(wanted.value, h)
        i, j, h = i[keep], j[keep], h[keep]
        if not len(i):
            return None
        sh, count = u.shingles(i, j)
        order = np.lexsort((sh, np.repeat(np.arange(len(i)), count)))
        of, sh = np.repeat(np.arange(len(i)), count)[order], sh[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
        of, sh = of[new], sh[new]
        off = np.searchsorted(of, np.arange(len(i) + 1)).astype(np.int32)
        doc = u.doc(i)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[doc]), pa.array(texts[doc]), pa.array((i - u.first[doc]).astype(np.int32)), pa.array((j - i).astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), pa.array(sh.view(np.int64)))], ["unit", "d", "t", "pos", "n", "shingles"])

    return lambda batches: _scan(batches, emit)


BITS = 24


PLACE = ["d", "t", "pos", "n"]


def repeated_passages(texts: DataFrame) -> DataFrame:
    """(d, t, pos, n): passages of texts (d, t, text) that occur earlier too, in order of (d, t, pos), out to where they
    differ."""
    schema = "h long, d long, t long, pos int, n int"
    share = texts.sparkSession.sparkContext.broadcast
    counts = texts.mapInArrow(_passage_rows(), schema).groupBy("h").agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "pos")).alias("at")).where("times > 1")
    counts = materialize(counts.drop("times"), "passages")
    rows = texts.mapInArrow(_passage_rows(share(bitmap(counts, "h", BITS))), schema).join(counts, "h")
    rows = materialize(rows.where(F.struct("d", "t", "pos") != F.col("at")).select("h", *PLACE), "repeats")
    edges = rows.repartition("d", "t").sortWithinPartitions("d", "t", "pos").mapInArrow(_edges, "h long")
    edges = materialize(edges.distinct().join(counts, "h"), "edges")
    near = materialize(texts.mapInArrow(_passage_rows(share(bitmap(edges, "h", BITS)), True), f"{schema}, room int, near binary").join(edges, "h"), "near")
    later = F.struct("d", "t", "pos") != F.col("at")
    first = near.where(~later).groupBy("h").agg(F.min(F.struct("pos", "room", "near")).alias("f")).select("h", F.col("f.pos").alias("first_pos"), F.col("f.room").alias("first_room"), F.col("f.near").alias("first_near"))
    near = near.where(later).drop("at")
    found = near.join(materialize(first, "firsts"), "h")
    found = materialize(found.mapInArrow(_extended, "key long, d long, t long, at int, pos int, n int, side int, more int, h long"), "extended")
    least = lambda x: materialize(x.groupBy("key").agg(F.count("*").alias("times"), F.min(F.struct("d", "t", "at")).alias("least")).where("times > 1").select("key", "least"), "beyond")
    beyond = found.where("key is not null")
    beyond = beyond.join(least(beyond).select("key"), "key").select("h", "d", "t", "at", "n", "side", "more").distinct()
    near = near.select("h", "d", "t", F.col("pos").alias("at"), "n", "room", "near")
    longer = materialize(near.join(beyond, ["h", "d", "t", "at", "n"]).mapInArrow(_longer, "key long, d long, t long, at int, pos int, n int"), "longer")
    longer = longer.join(least(longer), "key").where(F.struct("d", "t", "at") != F.col("least")).groupBy("d", "t", "at").agg(F.min("pos").alias("pos"), F.max(F.col("pos") + F.col("n")).alias("end"))
    return rows.select(*PLACE).unionByName(found.where("key is null").select(*PLACE)).unionByName(longer.select("d", "t", "pos", (F.col("end") - F.col("pos")).alias("n")))


def similar_links(shared: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(src, dst): links of Jaccard >= threshold by which any two similar units under one key are connected.

    shared: distinct (key, unit); sets: (unit, shingles). Keys of up to `block` units are compared in one task. Of others
    all units are compared with the least one. What is similar to it is thereby connected; what isn't is compared with
    all units of its key, in tasks of a block of the former and a block of all."""
    sizes = materialize(shared.groupBy("key").agg(F.count("*").alias("m"), F.min("unit").alias("lead")).where(F.col("m") > block), "hot")
    work, star = shared, None
    if not is_empty(sizes):
        hot = shared.join(small(sizes), "key").join(sets, "unit")
        lead = materialize(sizes.select("key", F.col("lead").alias("unit")).join(sets, "unit").select("key", F.col("shingles").alias("lead_shingles")), "leads")
        both = F.size(F.array_intersect("shingles", "lead_shingles"))
        near = both >= F.lit(threshold) * (F.size("shingles") + F.size("lead_shingles") - both) - 1e-9
        hot = materialize(hot.join(small(lead), "key").select("key", "unit", "m", "lead", near.alias("near")), "stars")
        star = hot.where("near and unit <> lead").select(F.col("lead").alias("src"), F.col("unit").alias("dst"))
        work = shared.join(small(sizes.select("key")), "key", "left_anti")
        unlike = materialize(hot.where("not near").groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("a")), "unlike")
        if not is_empty(unlike):
            hot = hot.join(small(unlike), "key").withColumn("b", F.ceil(F.col("m") / block).cast("int"))
            own = F.pmod(F.xxhash64("unit"), F.col("a")).cast("int"), F.pmod(F.xxhash64("unit"), F.col("b")).cast("int")
            rest = hot.where("not near").withColumn("i", own[0]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            every = hot.withColumn("j", own[1]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
            work = work.unionByName(rest.unionByName(every.select(rest.columns)).select(F.xxhash64("key", "i", "j").alias("key"), "unit").distinct())
    pairs = work.join(sets, "unit").repartition("key").sortWithinPartitions("key").select("key", "unit", "shingles")
    links = pairs.mapInArrow(_verified(threshold), "src long, dst long")
    return links if star is None else links.unionByName(star)


def similar_paragraphs(texts: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_LINE, block: int = BLOCK) -> DataFrame:
    """(d, t, pos, n): lines of texts (d, t, text) whose cluster of similar, not equal, lines has an earlier member."""
    bands, rows = tune_bands(threshold)
    share = texts.sparkSession.sparkContext.broadcast
    banded = materialize(texts.mapInArrow(_band_rows(bands, rows, min_words), "key long, unit long"), "bands")
    keys = materialize(banded.groupBy("key").agg(F.min("unit").alias("least"), F.max("unit").alias("most")).where("least <> most").select("key"), "keys")
    shared = hit_rows(banded, "key", share(bitmap(keys, "key", BITS)), True).join(keys, "key").distinct()
    shared = materialize(shared, "shared")
    units = shared.select("unit").distinct()
    lines = materialize(texts.mapInArrow(_line_rows(share(bitmap(units, "unit", BITS)), min_words), "unit long, d long, t long, pos int, n int, shingles array<long>"), "lines")
    sets = lines.groupBy("unit").agg(F.min_by("shingles", F.lit(0)).alias("shingles"), F.min(F.struct("d", "t", "pos")).alias("at"))
    sets = materialize(sets, "sets")
    links = similar_links(shared, sets.select("unit", "shingles"), threshold, block)
    comp = materialize(connected_components(links).withColumnRenamed("id", "unit"), "clusters")
    first = sets.select("unit", "at").join(comp, "unit").groupBy("component").agg(F.min("at").alias("at"))
    member = comp.join(first, "component").select("unit", "at")
    return lines.select("unit", *PLACE).join(member, "unit").where(F.struct("d", "t", "pos") != F.col("at")).select(*PLACE)


def removed_runs(pos: list[int], n: list[int], whole: list[bool], min_run: int = MIN_RUN) -> list[tuple[int, int]]:
    """Word ranges to remove from one text: repeated lines, and unions of repeated passages of min_run words or more."""
    got = [(p, p + k) for p, k, w in zip(pos, n, whole) if w]
    run: list[int] | None = None
    for p, k in sorted((p, k) for p, k, w in zip(pos, n, whole) if not w):
        if run is not None and p <= run[1]:
            run[1] = max(run[1], p + k)
        else:
            if run is not None and run[1] - run[0] >= min_run:
                got.append((run[0], run[1]))
            run = [p, p + k]
    if run is not None and run[1] - run[0] >= min_run:
        got.append((run[0], run[1]))
    out: list[list[int]] = []
    for a, b in sorted(got):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_text(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """text without the words of the runs and the white space behind each of them."""
    data = np.frombuffer(text, np.uint8)
    s, _, _ = words(data, np.array([0, len(data)]))
    s = np.append(s, len(data)).tolist()
    keep, at = [], 0
    for a, b in runs:
        keep.append(text[at : s[a]])
        at = s[b]
    keep.append(text[at:])
    return b"".join(keep)


def keys_of(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: what rows are known and ordered by. They are doc_id and, only where
    different texts have the same one, the text's hash (else 0, which costs nothing in a shuffle)."""
    d, t = free(docs.columns, "d", "t")
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), t: F.xxhash64(F.col("text").cast("string"))})
    shared = materialize(keyed.groupBy(d).agg(F.min(t).alias("a"), F.max(t).alias("b")).where("a <> b").select(d), "shared-ids")
    shared = small(shared.withColumn("b", F.lit(True)))
    other = free(keyed.columns, "shared")[0]
    found = keyed.join(shared.withColumnRenamed("b", other), d, "left") if not is_empty(shared) else keyed.withColumn(other, F.lit(None).cast("boolean"))
    return found.withColumn(t, F.when(F.col(other), F.col(t)).otherwise(F.lit(0))).select(*[F.col(f"`{c}`") for c in keyed.columns]), d, t


def marks(docs: DataFrame, d: str, t: str, threshold: float = THRESHOLD) -> DataFrame:
    """(d, t, pos, n, whole): for each document that loses words, arrays of its repeated units; d, t: from keys_of."""
    texts = docs.where("text is not null").select(F.col(d).alias("d"), F.col(t).alias("t"), F.col("text").cast("string").alias("text"))
    both = similar_paragraphs(texts, threshold).withColumn("whole", F.lit(True)).unionByName(repeated_passages(texts).withColumn("whole", F.lit(False)))
    both = both.where(F.col("d") != LAST).groupBy("d", "t").agg(F.collect_list(F.struct("pos", "n", "whole")).alias("u"))
    enough = F.aggregate(F.col("u"), F.lit(0), lambda a, x: a + x["n"]) >= MIN_RUN
    return materialize(both.where(enough).select("d", "t", F.col("u.pos").alias("pos"), F.col("u.n").alias("n"), F.col("u.whole").alias("whole")), "marks")


def dedup_paragraphs(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with repeated paragraphs and passages cut out of text, and two more columns: n_removed, n_spans (long).

    Every row comes back, also those left without words. Null texts stay null, empty ones empty. Rows are known by
    doc_id and text: rows with one doc_id and different texts are different documents; rows equal in both are one, and
    lose the same words. Rows without doc_id come after all others and lose nothing. Of equal occurrences the one in the least (doc_id,
    hash of the text), at the least word, stays. Columns named like the added ones are replaced, all others come back as
    they are; an empty table gives an empty result."""
    ready(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_removed", "n_spans")])
    keyed, d, t = keys_of(docs)
    found = marks(keyed, d, t, threshold)
    key, pos, count, whole_line = free([*keyed.columns, "n_removed", "n_spans"], "h", "pos", "n", "whole")
    found = found.select(F.col("d").alias(d), F.col("t").alias(t), F.xxhash64("d", "t").alias(key), F.col("pos").alias(pos), F.col("n").alias(count), F.col("whole").alias(whole_line))
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(found, key, BITS))
    keyed = keyed.withColumn(key, F.xxhash64(d, t))
    none = F.lit(0).cast("long")
    original = [F.col(f"`{c}`") for c in docs.columns]
    rest = hit_rows(keyed, key, wanted, False).select(*original, none.alias("n_removed"), none.alias("n_spans"))
    hit = hit_rows(keyed, key, wanted, True).join(found.drop(key), [d, t], "left").select(*original, pos, count, whole_line)
    schema = docs.withColumns({"n_removed": none, "n_spans": none}).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts, removed, spans = [], [], []
                for text, p, n, w in zip(b.column("text").to_pylist(), *(b.column(c).to_pylist() for c in (pos, count, whole_line))):
                    runs = removed_runs(p, n, w) if p is not None and text is not None else []
                    texts.append(cut_text(text.encode(), runs).decode() if runs else text)
                    removed.append(sum(y - x for x, y in runs))
                    spans.append(len(runs))
                cols = list(b.columns[: len(schema) - 2])
                cols[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], schema.names)

    return rest.unionByName(hit.mapInArrow(run, schema))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns of dedup_paragraphs: sizes, removals and a digest of the kept text."""
    got = dedup_paragraphs(docs.select("doc_id", "text"))
    return got.select("doc_id", "n_removed", "n_spans", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
