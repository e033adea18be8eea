"""SimHash fingerprints and their near pairs by multi-index hashing.

Fingerprints within `radius` bits agree up to radius // 2 bits on one of their two 32-bit halves. Every distinct
fingerprint is put in a table under each half; a ball of that radius around each half is looked up in the table,
and the complete distance of what meets is verified. Of two halves one bit apart exactly one has odd parity, so
only odd halves list their 32 neighbours. A half that very many fingerprints share is looked up by the segments of the
other half besides: of four segments of eight bits at least one agrees.

A text is held whole, with some ten words of eight bytes for each of its words while it is fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, bitmap, free, hit_rows, materialize, ready, steps, text_buffers, words
from loomspark.operators.components import connected_components
from loomspark.scratch import is_empty, small

SHINGLE, SEED = 3, 42
#: Rows of one bucket compared in one block.
BLOCK = 2048
#: Fingerprints under one half from which on it is split by the other half's segments.
HOT = 1024
BITS = 24


def fingerprint_bytes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The reference form, for one text: majority bit of the shingles' XXH64."""
    w = text.lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def fingerprints_batch(data: np.ndarray, off: np.ndarray, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints (uint64) of the texts in one buffer."""
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    s, e, first = words(data, off)
    if not len(s):
        return out
    # words joined by single spaces: word i lies at a[i] .. a[i] + len
    ln = e - s
    a = np.cumsum(ln + 1) - (ln + 1)
    buf = np.full(int((ln + 1).sum()), 32, np.uint8)
    idx = np.arange(int(ln.sum())) - np.repeat(np.cumsum(ln) - ln, ln)
    buf[np.repeat(a, ln) + idx] = LOWER[data[np.repeat(s, ln) + idx]]
    b, z = buf.tobytes(), a + ln
    count = np.diff(first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    has = np.flatnonzero(shingles)
    span = np.minimum(count[has], width)
    begin = np.repeat(first[:-1][has], shingles[has]) + (np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles[has]) - shingles[has], shingles[has]))
    stop = begin + np.repeat(span, shingles[has]) - 1
    h = xxhash.xxh64_intdigest
    got = np.array([h(b[i:j], seed) for i, j in zip(a[begin].tolist(), z[stop].tolist())], np.uint64)
    bits = np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.cumsum(shingles[has]) - shingles[has]
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    out[has] = np.packbits(2 * ones > shingles[has][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off, _ = text_buffers(b.column("text"))
        fp = [fingerprints_batch(data[off[i] : off[j]], off[i : j + 1] - off[i], SHINGLE, SEED) for i, j in steps(off)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(fp or [np.zeros(0, np.uint64)]).view(np.int64))], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t, fp) for every row, t a hash of the text; null texts and texts without words get fingerprint 0."""
    ready(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(_fingerprint_rows, "doc_id long, t long, fp long")


def _ball_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.left_shift(np.int64(1), np.arange(32, dtype=np.int64))
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            b = whole.slice(at, 20_000)
            fp, rep = b.column("fp").to_numpy(), b.column("rep")
            keys, src, own = [], [], []
            for part in (0, 1):
                half = (fp >> (32 * part)) & 0xFFFFFFFF
                tag = np.int64(part) << 32
                odd = np.flatnonzero(np.bitwise_count(half) & 1)
                keys += [half | tag, ((half[odd][:, None] ^ flips) | tag).ravel()]
                src += [np.arange(len(fp)), np.repeat(odd, 32)]
                own += [np.ones(len(fp), bool), np.zeros(len(odd) * 32, bool)]
            i = np.concatenate(src)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[i]), rep.take(pa.array(i)), pa.array(np.concatenate(own))], ["k", "fp", "rep", "own"])


def _forest(fp: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (row, row) of a spanning forest of one bucket's links: own-own and own-looked-up rows within radius."""
    n, label = len(fp), np.arange(len(fp))
    out = []
    table = np.flatnonzero(own)
    for i in table.tolist():
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            other = label[lo:hi] != label[i]
            if not other.any():
                continue
            j = np.flatnonzero(other)
            j = j[np.bitwise_count(fp[lo:hi][j] ^ fp[i]) <= radius] + lo
            for r in np.unique(label[j]).tolist():
                out.append((i, int(j[label[j] == r][0])))
                label[label == r] = label[i]
    return out


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. Buckets that hold a table row and another row are verified; links leave as stars."""
    rest: list[np.ndarray] | None = None

    def linked(cols, closed):
        k, fp, rep, own = cols
        cut = np.flatnonzero(np.diff(k)) + 1
        lo = np.concatenate([[0], cut]).astype(np.int64)
        hi = np.concatenate([cut, [len(k)]]).astype(np.int64)
        if not closed:
            lo, hi, keep = lo[:-1], hi[:-1], lo[-1]
        else:
            keep = len(k)
        has = np.add.reduceat(own, lo, dtype=np.int64) if len(lo) else lo
        src, dst = [], []
        for a, b in zip(lo[(hi - lo > 1) & (has > 0)].tolist(), hi[(hi - lo > 1) & (has > 0)].tolist()):
            for i, j in _forest(fp[a:b], own[a:b], radius):
                src.append(rep[a + i])
                dst.append(rep[a + j])
        return (np.array(src, np.int64), np.array(dst, np.int64)), [c[keep:] for c in cols]

    def batch(links):
        return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["src", "dst"])

    for b in batches:
        cols = [b.column("k").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("rep").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)]
        if not len(cols[0]):
            continue
        cols = [np.concatenate(x) for x in zip(rest, cols)] if rest is not None else cols
        links, rest = linked(cols, False)
        if len(links[0]):
            yield batch(links)
    if rest is not None and len(rest[0]):
        links, _ = linked(rest, True)
        yield batch(links)


def near_classes(prints: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of prints (doc_id, fp) that links to another one.

    component_id is the least doc_id of all rows whose fingerprints are reachable over links of `radius` bits or
    fewer. radius is at most 3, the bound that two halves with balls of one bit cover."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "fingerprints")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    halves = reps.select(F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("k"))
    crowded = materialize(halves.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k"), "crowded")
    rows = reps.mapInArrow(_ball_rows, "k long, fp long, rep long, own boolean")
    if not is_empty(crowded):
        crowded = small(crowded)
        other = F.when(F.shiftrightunsigned("k", 32) == 0, high).otherwise(low)
        parts = F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned(other, 8 * j).bitwiseAND(F.lit(255)).alias("v")) for j in range(4)])
        split = rows.join(crowded, "k").withColumn("p", F.explode(parts)).select(F.xxhash64("k", "p.j", "p.v").alias("k"), "fp", "rep", "own")
        rows = rows.join(crowded, "k", "left_anti").unionByName(split)
    sorted_rows = rows.repartition("k").sortWithinPartitions("k")
    links = sorted_rows.mapInArrow(lambda it: _links(it, radius), "src long, dst long")
    comp = connected_components(links)
    return reps.join(comp.withColumnRenamed("id", "rep"), "rep").select("fp", F.col("component").alias("component_id"))


def simhash_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable, itself included).

    Equal fingerprints link at distance 0, fingerprint 0 of texts without words too. Rows without doc_id take
    part with their fingerprint; a class of such rows alone has no id (null). Repeated rows each return a row; other
    columns are ignored; an empty table gives an empty result."""
    prints = materialize(fingerprints(docs), "simhash")
    classes = near_classes(prints, radius)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # written first, so that both sides of the last join are plain exchanges and a hot fingerprint's rows can be split
    return prints.join(materialize(least, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs without the near-duplicates: of each class the row with the least (doc_id, hash of the text) stays, null ids
    last, and of rows equal in both one. A class is a component of simhash_components; rows without doc_id whose
    fingerprint no other row is linked to are a class by fingerprint. All columns come back as they are; an empty table
    gives an empty result. Only rows that may go are shuffled."""
    doc_id, t, known, verdict = free(docs.columns, "d", "t", "h", "v")
    prints = materialize(fingerprints(docs), "simhash")
    classes = prints.join(materialize(near_classes(prints, radius), "near"), "fp", "left")
    classes = classes.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"), "doc_id", "t").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    classes = materialize(classes.withColumn("place", place), "rows")
    least = classes.groupBy("component_id", "alone").agg(F.min("place").alias("least"))
    same = F.col("a.component_id").eqNullSafe(F.col("b.component_id")) & F.col("a.alone").eqNullSafe(F.col("b.alone"))
    judged = classes.alias("a").join(least.alias("b"), same).select("doc_id", "t", (F.col("place") == F.col("least")).alias("stays"), "n")
    judged = materialize(judged.where("not stays or n > 1").select(F.col("doc_id").alias(doc_id), F.col("t").alias(t), F.xxhash64("doc_id", "t").alias(known), F.col("stays").alias(verdict)), "judged")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(judged, known, BITS))
    keyed = docs.withColumns({doc_id: F.col("doc_id").cast("long"), t: F.xxhash64(F.col("text").cast("string"))}).withColumn(known, F.xxhash64(doc_id, t))
    hits = hit_rows(keyed, known, bits, True).alias("a").join(judged.alias("b"), F.col(f"a.{doc_id}").eqNullSafe(F.col(f"b.{doc_id}")) & (F.col(f"a.{t}") == F.col(f"b.{t}")), "left")
    hits = hits.select("a.*", F.col(f"b.{verdict}").alias(verdict))
    names = [F.col(f"`{c}`") for c in docs.columns]
    parts = [hit_rows(keyed, known, bits, False), hits.where(F.col(verdict).isNull()), hits.where(verdict).dropDuplicates([doc_id, t])]
    return parts[0].select(*names).unionByName(parts[1].select(*names)).unionByName(parts[2].select(*names))
