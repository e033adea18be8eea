"""Best-fit decreasing packing of token sequences, planned on the histogram of lengths.

Best-fit decreasing depends on lengths alone, and equal bins are interchangeable. The plan is made over at most
`capacity` distinct lengths with their counts: open bins stand in groups of equal remaining capacity, a segment
tree over remaining capacities finds the tightest open group in logarithmic time, and a run of equal pieces fills
a whole group at once. The plan's size follows the number of distinct lengths, not the corpus; pieces find their
place by their rank among pieces of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, U64, Rolling, materialize, mix, ready, spread, steps, text_buffers, words

CAPACITY = 4096
END_ID = 1
#: Units whose ids a worker keeps (about 100 MB); beyond it the table starts anew.
CACHE_WORDS = 1_500_000
STEP = 1 << 19


class TightestFit:
    """Segment tree over remaining capacities 0..capacity that answers: the least capacity >= need with an open bin."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.size
        self.open[i] = is_open
        i //= 2
        while i:
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]
            i //= 2

    def find(self, need: int) -> int:
        i = need + self.size
        if i >= 2 * self.size:
            return -1
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def plan_bins(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, count, first bin, pieces a bin, offset in the bin) of the best-fit decreasing packing.

    Pieces first rank .. first rank + count - 1 of a length lie in consecutive bins, `pieces a bin` in each."""
    tree = TightestFit(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining -> (first bin, bins)
    rows, bins = [], 0

    def add(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            groups.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left:
            r = tree.find(length)
            if r < 0:
                per = capacity // length
                r, first, n = capacity, bins, -(-left // per)
                bins += n
            else:
                per = r // length
                first, n = groups[r].pop()
                if not groups[r]:
                    tree.set(r, False)
            full = min(n, left // per)
            rest = min(left - full * per, per) if full < n else 0
            if full:
                rows.append((length, rank, full * per, first, per, capacity - r))
                add(r - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if rest:
                rows.append((length, rank, rest, first + full, per, capacity - r))
                add(r - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
            used = full + bool(rest)
            add(r, first + used, n - used)
    return rows


class UnitTable:
    """Open-addressed table from pairs of 64-bit hashes to runs of ids, looked up and filled by whole arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.twins, self.place, self.used = np.zeros(1 << 16, U64), np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int32), 0
        self.pool, self.pool_used = np.zeros(1 << 18, np.uint32), 0
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def find(self, h: np.ndarray, twin: np.ndarray) -> np.ndarray:
        """Entry of each pair, -1 where there is none. Hash 0 stands for itself plus one."""
        h = np.where(h == 0, U64(1), h)
        mask = U64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1)
        at = np.arange(len(h))
        while len(at):
            got = self.keys[slot[at]]
            hit = (got == h[at]) & (self.twins[slot[at]] == twin[at])
            out[at[hit]] = self.place[slot[at[hit]]]
            at = at[~hit & (got != 0)]
            slot[at] = (slot[at] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, twin: np.ndarray, entry: np.ndarray) -> None:
        mask = U64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        at = np.arange(len(h))
        while len(at):
            empty = self.keys[slot[at]] == 0
            _, first = np.unique(slot[at[empty]], return_index=True)
            won = at[empty][first]
            self.keys[slot[won]], self.twins[slot[won]], self.place[slot[won]] = h[won], twin[won], entry[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            at = at[rest[at]]
            slot[at] = np.where(self.keys[slot[at]] != 0, (slot[at] + 1) & int(mask), slot[at])

    def add(self, h: np.ndarray, twin: np.ndarray, runs: list[bytes]) -> None:
        """Adds absent pairs of distinct first hashes with their ids, as little-endian unsigned 32-bit."""
        h = np.where(h == 0, U64(1), h)
        n = np.array([len(r) // 4 for r in runs], np.int64)
        ids = np.frombuffer(b"".join(runs), "<u4")
        while self.pool_used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used + len(h) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        entry = np.arange(self.used, self.used + len(h))
        self.pool[self.pool_used : self.pool_used + len(ids)] = ids
        self.begin[entry], self.count[entry] = self.pool_used + np.cumsum(n) - n, n
        self.used, self.pool_used = self.used + len(h), self.pool_used + len(ids)
        if 4 * self.used > len(self.keys):
            have = self.keys != 0
            old = self.keys[have], self.twins[have], self.place[have]
            size = 4 * len(self.keys)
            self.keys, self.twins, self.place = np.zeros(size, U64), np.zeros(size, U64), np.zeros(size, np.int32)
            self._put(*old)
        self._put(h, twin, entry)


class WordTokenizer:
    """Ids of whole texts through a table of the ids of their units.

    Units are what the tokenizer treats apart: white-space separated words, and of words that are Latin letters with a
    tail of signs, the letters and the tail. Valid for tokenizers that never join characters across ASCII white space,
    split letter runs from runs of other signs, and fold case. Unknown letter runs are encoded many at a time and told
    apart by the encoding's word numbers; other unknown units one by one; texts with a special token's beginning,
    `<|`, whole. Units are known by two 64-bit hashes of different kinds: one of the bytes and their places, one of the
    length and the first and last bytes."""

    TAIL = b".,;:!?%$&*#|()[]{}\"/+=_~^@"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = UnitTable()
        self.letter, self.tail = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*range(97, 123), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))]] = True
        self.tail[list(self.TAIL)] = True

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, runs: list[str]) -> list[bytes]:
        got = self.tokenizer.encode(" ".join(runs), add_special_tokens=False)
        of = np.array(got.word_ids, np.int64)
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        if len(begin) != len(runs):  # a letter that normalizes to more than letters
            return [self._raw(w) for w in runs]
        raw, cut = np.array(got.ids, "<u4").tobytes(), [*(begin * 4).tolist(), 4 * len(of)]
        return [raw[i:j] for i, j in zip(cut, cut[1:])]

    def _learn(self, raw: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, twin: np.ndarray, plain: np.ndarray) -> None:
        if self.table.used > CACHE_WORDS:
            self.table.clear()
        texts = [raw[i:j].decode() for i, j in zip(start.tolist(), end.tolist())]
        for at in np.array_split(np.flatnonzero(plain), max(1, int(plain.sum()) // 4096)):
            if len(at):
                self.table.add(h[at], twin[at], self._letters([texts[i] for i in at.tolist()]))
        at = np.flatnonzero(~plain)
        if len(at):
            self.table.add(h[at], twin[at], [self._raw(texts[i]) for i in at.tolist()])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts in one buffer."""
        original, data = data, LOWER[data]
        s, e, first = words(data, off)
        n = len(s)
        if n:
            others = np.maximum.accumulate(np.where(self.tail[data], -1, np.arange(len(data))))
            mid = np.maximum(s, others[e - 1] + 1)
            letters = np.concatenate([[0], np.cumsum(self.letter[data])])
            plain = letters[mid] - letters[s] == mid - s
            mid = np.where(plain, mid, e)
            # a core and a tail for each word; either may be empty
            us, ue = np.stack([s, mid], 1).ravel(), np.stack([mid, e], 1).ravel()
            kind = np.stack([plain, np.zeros(n, bool)], 1).ravel()
            real = ue > us
            us, ue, kind = us[real], ue[real], kind[real]
            h = Rolling(data).of(us, ue)
            # up to eight bytes from either end: all of most units
            eight = np.concatenate([data, np.zeros(8, np.uint8)])
            eight = np.lib.stride_tricks.sliding_window_view(eight, 8)
            size = (ue - us).astype(U64)
            short = np.minimum(size, U64(8))
            cut = (U64(8) - short) * U64(8)
            begin = np.ascontiguousarray(eight[us]).view(U64).ravel() << cut
            close = np.ascontiguousarray(eight[np.maximum(ue - 8, us)]).view(U64).ravel() << cut
            twin = begin + mix(close + size)
            entry = self.table.find(h, twin)
            while len(miss := np.flatnonzero(entry < 0)):  # again where the table began anew, or where first hashes agree
                _, one = np.unique(h[miss], return_index=True)
                one = miss[one]
                self._learn(data.tobytes(), us[one], ue[one], h[one], twin[one], kind[one])
                entry = self.table.find(h, twin)
            count = self.table.count[entry]
            ids = self.table.pool[spread(self.table.begin[entry], count)]
            per = np.zeros(2 * n, np.int64)
            per[real] = count
            cut = np.concatenate([[0], np.cumsum(per)])[2 * first]
        else:
            ids, cut = np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        docs = np.unique(np.searchsorted(off, special, side="right") - 1)
        if len(docs):
            parts = [ids[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            for d in docs.tolist():
                parts[d] = np.frombuffer(self._raw(original[off[d] : off[d + 1]].tobytes().decode()), "<u4")
            ids, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, cut


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32, part, local): the cut token sequences of every row.

    local is the piece's rank among those of its length in its partition `part`; row tells repeated rows apart."""
    ready(docs.sparkSession)
    end = np.uint32(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or tokenizer_path()
        if where not in _TOKENIZERS:
            _TOKENIZERS[where] = WordTokenizer(where)
        tok, seen, part, row = _TOKENIZERS[where], np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId(), 0
        for b in batches:
            data, off, _ = text_buffers(b.column("text"))
            for i, j in steps(off, STEP):
                ids, cut = tok.encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = np.insert(ids, cut[1:], end).astype("<u4")
                cut = cut + np.arange(len(cut))
                size = np.diff(cut)
                n_pieces = -(-size // capacity)
                k = np.repeat(np.arange(j - i), n_pieces)
                p = spread(np.zeros(j - i, np.int64), n_pieces)
                start = p * capacity
                length = np.minimum(size[k] - start, capacity)
                first = cut[k] + start
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(first.tolist(), (first + length).tolist())]
                order = np.argsort(length, kind="stable")
                run = np.flatnonzero(np.diff(length[order], prepend=-1))
                local = np.empty(len(k), np.int64)
                local[order] = seen[length[order]] + np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(i + k)), pa.array(row + i + k), pa.array(p.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64)), pa.array(np.full(len(k), part, np.int32)), pa.array(local)], ["doc_id", "row", "piece", "start", "length", "ids_crc32", "part", "local"])
            row += b.num_rows

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part int, local long")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with length, part, local) plus sequence_id and offset, by best-fit decreasing over all rows.

    Driver memory: one count for each distinct length and the plan made from them, which is also what is broadcast: both
    are bounded by the capacity. The counts before each partition, of which there may be many, meet the pieces in a
    shuffle join: small rows, by partition and length. An empty table packs to none."""
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    hist = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = np.array(sorted(plan_bins(hist, capacity)), np.int64).reshape(-1, 6)
    shared = cut.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        span = np.int64(1) << np.int64(48)
        key = p[:, 0] * span + p[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("local").to_numpy() + b.column("_base").to_numpy()
            r = p[np.searchsorted(key, length * span + rank, side="right") - 1] if len(p) else np.zeros((0, 6), np.int64)
            k = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return cut.join(bases.hint("shuffle_hash"), ["part", "length"]).select(*names, "_base").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: just the end id. Repeated rows each have pieces of their own, rows without doc_id too;
    other columns are ignored; an empty table gives no pieces. Which of equally long pieces goes where is open. A text is
    held whole, with some ten words of eight bytes for each of its words."""
    cut = materialize(pieces(docs, path, capacity, end_id), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
