"""Exact and near-duplicate removal: SimHash, MinHash bands, line Jaccard, each keeping the first of what is alike.

"First-keep": in order of `pos` a row stays unless an earlier row that stayed is similar. That is neither transitive
closure nor a per-group minimum, so the pair operators return links and `first_keep` resolves them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.scratch import is_empty, materialize, ready

MIN_UNIQUE_TOKENS, MAX_DISTANCE = 4, 3
PERMUTATIONS, BANDS = 128, 16
PRIME = 4294967291
SHINGLE_LINES = 3
#: Items of the lists that Python works on at once.
SLICE_ITEMS = 1 << 17
LSH_FROM = 64
SIMILARITY = float(np.float32(0.92))


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """The first row by pos of each whitespace-normalised content. Only 16-byte digests and positions are shuffled."""
    first = chunks.groupBy(F.md5(T.normalize_whitespace(F.col("content"))).alias("_k")).agg(F.min("pos").alias("_keep"))
    return chunks.join(first.select("_keep"), F.col("pos") == F.col("_keep"), "left_semi")


def members(chunks: DataFrame) -> DataFrame:
    """(pos, exact, first) for every row: the first row of its exact copies, and of the rows with its fingerprint.

    The pair operators link first rows only; with this table the links of all other rows follow. Fingerprint 0 never
    matches: such a row's first is its exact one."""
    keys = materialize(chunks.select("pos", F.md5(T.normalize_whitespace(F.col("content"))).alias("_k")), "digests")
    exact = materialize(keys.groupBy("_k").agg(F.min("pos").alias("exact")), "exact")
    prints = materialize(simhash(chunks.join(exact.select("exact"), F.col("pos") == F.col("exact"), "left_semi")), "prints")
    firsts = prints.where("fp <> 0").groupBy("fp").agg(F.min("pos").alias("first"))
    of = prints.join(firsts, "fp", "left").select(F.col("pos").alias("exact"), F.coalesce("first", "pos").alias("first"))
    # written first, so that both sides of the last join are plain exchanges and a hot digest's rows can be split
    return keys.join(materialize(exact.join(of, "exact"), "members"), "_k").select("pos", "exact", "first")


def _digest_words(items: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two unsigned 32-bit words of md5 for each distinct item."""
    raw = b"".join(hashlib.md5(x.encode()).digest()[:8] for x in items.to_pylist())
    words = np.frombuffer(raw, ">u4").reshape(-1, 2).astype(np.int64)
    return words[:, 0], words[:, 1]


def _encoded(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct items, code of each item, offsets of the lists)."""
    flat = lists.flatten().dictionary_encode()
    sizes = np.array(pc.list_value_length(lists).fill_null(0), np.int64)
    return flat.dictionary, np.asarray(flat.indices, np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about SLICE_ITEMS items of a list column, one row at least: items become objects
    of many times their size."""
    for b in batches:
        ends = np.cumsum(np.array(pc.list_value_length(b.column(column)).fill_null(0), np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_ITEMS, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _simhash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, "tokens"):
        items, code, off = _encoded(b.column("tokens"))
        high, low = _digest_words(items)
        word = (low << 32 | high).astype(np.uint64)  # the first digest word has bits 0 to 31
        fp, has = np.zeros(b.num_rows, np.uint64), np.flatnonzero(np.diff(off))
        signs = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
        for i in has.tolist():
            own = code[off[i] : off[i + 1]]
            kinds, times = np.unique(own, return_counts=True)
            if len(kinds) >= MIN_UNIQUE_TOKENS:
                sums = times @ signs[kinds].astype(np.int64)
                fp[i] = np.packbits(sums > 0, bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([b.column("pos"), pa.array(fp.view(np.int64))], ["pos", "fp"])


def simhash(chunks: DataFrame) -> DataFrame:
    """(pos, fp): 64 sign sums of term counts; 0 for rows of fewer than four different tokens.

    A row's sums need only that row, so nothing is shuffled: tokens are made in the JVM, and Arrow batches of them
    are summed as arrays, with one digest for each distinct token of a batch."""
    ready(chunks.sparkSession)
    return chunks.select("pos", T.tokenize_words(F.col("content")).alias("tokens")).mapInArrow(_simhash_rows, "pos long, fp long")


def _first_of_equal(prints: DataFrame, key: str) -> DataFrame:
    """Rows with equal keys behave alike towards all others, so only the first of them takes part in pairing."""
    return prints.groupBy(key).agg(F.min("pos").alias("pos"))


def simhash_pairs(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance), a < b, of non-zero fingerprints at most `distance` (3 at most) bits apart.

    Of two 32-bit halves one differs in at most one bit. Every fingerprint stands under both its halves and looks both up;
    of halves one bit apart exactly one has odd parity, and that one looks its 32 neighbours up besides."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    live = prints.where("fp <> 0").select("pos", "fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)

    def ball(half: Column, part: int) -> Column:
        tag = F.lit(part << 32)
        own = F.array(half.bitwiseOR(tag))
        near = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: half.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseOR(tag))
        return F.when(F.bit_count(half) % 2 == 1, F.concat(own, near)).otherwise(own)

    table = live.select("pos", "fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("k"))
    looked = live.select("pos", "fp", F.explode(F.concat(ball(low, 0), ball(high, 1))).alias("k"))
    d = T.hamming(F.col("a.fp"), F.col("b.fp"))
    met = looked.alias("a").join(table.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.pos") != F.col("b.pos"))).where(d <= distance)
    return met.select(F.least("a.pos", "b.pos").alias("a"), F.greatest("a.pos", "b.pos").alias("b"), d.alias("distance")).distinct()


def minhash(chunks: DataFrame, width: int = SHINGLE_LINES, permutations: int = PERMUTATIONS) -> DataFrame:
    """(pos, sig): for each i the least (h1 + i * h2) mod PRIME over the line shingles; PRIME where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prime = np.uint64(PRIME)
        for b in _slices(batches, "shingles"):
            items, code, off = _encoded(b.column("shingles"))
            a, c = (x.astype(np.uint64) for x in _digest_words(items))
            now, step = (a % prime)[code], (np.maximum(c, 1) % prime)[code]
            less = np.empty_like(now)
            sig = np.full((b.num_rows, permutations), PRIME, np.int64)
            has = np.flatnonzero(np.diff(off))
            for i in range(permutations if len(has) else 0):
                sig[has, i] = np.minimum.reduceat(now, off[has])
                now += step
                np.subtract(now, prime, out=less)  # wraps round to a large number where now is the remainder already
                np.minimum(now, less, out=now)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * permutations, pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("pos"), lists], ["pos", "sig"])

    ready(chunks.sparkSession)
    return chunks.select("pos", T.line_shingles(F.col("content"), width).alias("shingles")).mapInArrow(run, "pos long, sig array<long>")


def signature_similarity(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(permutations))


def lsh_pairs(sigs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """(a, b, similarity), a < b, of signatures that share a band and agree in at least `threshold` of all places."""
    rows = permutations // bands
    sigs = materialize(sigs, "signatures")
    keyed = sigs.select("pos", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.slice("sig", k * rows + 1, rows)))).alias("band", "key"))
    met = keyed.alias("a").join(keyed.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct()
    both = met.join(sigs.select(F.col("pos").alias("a"), F.col("sig").alias("_x")), "a").join(sigs.select(F.col("pos").alias("b"), F.col("sig").alias("_y")), "b")
    return both.select("a", "b", signature_similarity(F.col("_x"), F.col("_y"), permutations).alias("similarity")).where(F.col("similarity") >= threshold)


def line_jaccard_pairs(chunks: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard), a < b, of line sets with Jaccard >= threshold; empty sets match nothing.

    Prefix filter: of two sets at the threshold, each one's rarest n - ceil(threshold * n) + 1 lines meet. So lines
    that very many rows share are joined only where nothing rarer is left."""
    sets = materialize(chunks.select("pos", F.transform(T.line_set(F.col("content")), lambda x: F.xxhash64(x)).alias("s")).where(F.size("s") > 0), "lines")
    each = sets.select("pos", F.explode("s").alias("h"))
    rare = each.groupBy("h").agg(F.count("*").alias("df"))
    n = F.size("o")
    ordered = each.join(rare, "h").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o"))
    prefix = ordered.select("pos", F.explode(F.slice("o", F.lit(1), n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1)["h"]).alias("h"))
    met = prefix.alias("a").join(prefix.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct()
    both = met.join(sets.select(F.col("pos").alias("a"), F.col("s").alias("_x")), "a").join(sets.select(F.col("pos").alias("b"), F.col("s").alias("_y")), "b")
    inter = F.size(F.array_intersect("_x", "_y"))
    return both.select("a", "b", (inter / (F.size("_x") + F.size("_y") - inter)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def first_keep(pairs: DataFrame) -> DataFrame:
    """(pos) of the rows that go, from links (a, b), a < b: i stays if and only if no earlier linked row stays.

    Each round settles every row all of whose earlier neighbours are settled; rounds follow the longest chain."""
    left = materialize(pairs.select("a", "b").distinct(), "links")
    gone = left.select(F.col("b").alias("pos")).limit(0)
    while not is_empty(left):
        waiting = left.select(F.col("b").alias("a")).distinct()
        out = materialize(left.join(waiting, "a", "left_anti").select(F.col("b").alias("pos")).distinct(), "dropped")
        gone = gone.unionByName(out)
        left = materialize(left.join(out.withColumnRenamed("pos", "a"), "a", "left_anti").join(out.withColumnRenamed("pos", "b"), "b", "left_anti"), "links")
    return gone


def _without(chunks: DataFrame, prints: DataFrame, key: str, pairs_of, matters: Column | None = None) -> DataFrame:
    """chunks without later rows of equal keys and without what first_keep drops of the pairs among first ones."""
    prints = materialize(prints, "prints")
    live = prints if matters is None else prints.where(matters)
    firsts = materialize(_first_of_equal(live, key), "firsts")
    equal = live.join(firsts.select("pos"), "pos", "left_anti").select("pos")
    gone = equal.unionByName(first_keep(pairs_of(firsts)))
    return chunks.join(gone, "pos", "left_anti")


def simhash_dedup(chunks: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """chunks without rows near an earlier row that stays; fingerprint 0 never matches."""
    return _without(chunks, simhash(chunks), "fp", lambda f: simhash_pairs(f, distance), F.col("fp") != 0)


def lsh_dedup(chunks: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    return _without(chunks, minhash(chunks), "sig", lambda f: lsh_pairs(f, threshold))


def jaccard_dedup(chunks: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    return chunks.join(first_keep(line_jaccard_pairs(chunks, threshold)), "pos", "left_anti")


@dataclass(frozen=True)
class DedupStats:
    before: int
    after: int
    exact_removed: int
    simhash_removed: int
    near_removed: int
    used_lsh: bool


def dedup(chunks: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DedupStats]:
    """Exact, then SimHash, then MinHash bands from LSH_FROM rows on and exact line Jaccard below."""
    n0 = chunks.count()
    exact = materialize(exact_dedup(chunks), "exact")
    n1 = exact.count()
    near = materialize(simhash_dedup(exact), "simhash")
    n2 = near.count()
    lsh = n2 >= LSH_FROM
    out = materialize(lsh_dedup(near, threshold) if lsh else jaccard_dedup(near, threshold), "near")
    n3 = out.count()
    return out, DedupStats(n0, n3, n0 - n1, n1 - n2, n2 - n3, lsh)
