"""Multilingual language identification: a mixture of languages per document, fitted by EM.

Training counts character trigrams of every labelled document per language (hashed to BUCKETS classes, so the model
is at most languages x BUCKETS floats). A document is a bag of words; the words' trigram likelihoods under each
language are fixed, and expectation-maximisation estimates the document's language proportions. The language set
grows greedily, by the language that most raises the penalised log-likelihood, while it rises; of languages that raise
it equally the first by code point.

A text is held whole, with about ten words of eight bytes for each of its letters and one number a word and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import U64, free, materialize, mix, ready, steps, text_buffers

BUCKETS = 1 << 15
#: Added to each trigram count.
PRIOR = 0.5
EM_ROUNDS = 8
#: Words of one text that one step holds; longer texts run alone.
STEP = 1 << 18
UNKNOWN = "und"
#: Languages that training takes at most; more labels than that are no languages, and their counts would fill the driver.
MOST_LANGUAGES = 1000
#: Code points from here on hold no letters.
LETTERS_END = 0x40000

_LETTERS: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else (built once a worker)."""
    if "t" not in _LETTERS:
        t = np.zeros(LETTERS_END, np.uint32)
        for i in range(LETTERS_END):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low[0])
        _LETTERS["t"] = t
    return _LETTERS["t"]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded letter or 0, text index) per code point of the texts in one UTF-8 buffer; malformed bytes are U+FFFD."""
    try:
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        pos = np.flatnonzero((data & 0xC0) != 0x80)
    except UnicodeDecodeError:
        parts = [np.frombuffer(data[i:j].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i, j in zip(off[:-1], off[1:])]
        sizes = np.array([len(x) for x in parts], np.int64)
        cp, pos = np.concatenate(parts), None
    t = letters()
    folded = np.where(cp < len(t), t[np.minimum(cp, len(t) - 1)], 0)
    return folded, np.searchsorted(pos, off) if pos is not None else np.append(0, np.cumsum(sizes))


def word_trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket per trigram, first trigram of each word, text of each word, letters per text).

    A word of n letters has n trigrams, those of its letters between two border marks."""
    f, cut = code_points(data, off)
    n = len(f)
    alpha = np.zeros(n + 2, bool)
    alpha[1:-1] = f > 0
    edge = np.zeros(n + 1, bool)
    edge[cut[(cut > 0) & (cut < n)]] = True  # a text's border ends a word
    pad = np.zeros(n + 2, np.uint32)
    pad[1:-1] = f
    at = np.flatnonzero(f > 0)
    left = np.where(edge[at], 0, pad[at])
    right = np.where(edge[at + 1] if n else at, 0, pad[at + 2])
    tri = (left.astype(U64) << U64(42)) | (pad[at + 1].astype(U64) << U64(21)) | right.astype(U64)
    bucket = (mix(tri) >> U64(49)).astype(np.int64)
    first = np.flatnonzero(left == 0)
    doc = np.searchsorted(cut, at[first], side="right") - 1
    per = np.diff(np.searchsorted(at, cut))
    return bucket, first, doc, per


@dataclass(frozen=True)
class LanguageModel:
    """languages in code point order; logp[bucket, language]."""

    languages: list[str]
    logp: np.ndarray


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def out():
        for k, v in sums.items():
            nz = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(nz), pa.string()), pa.array(nz.astype(np.int32)), pa.array(v[nz])], ["lang", "bucket", "n"])

    for b in batches:
        langs = b.column("lang").to_pylist()
        data, off, _ = text_buffers(b.column("text"))
        for i, j in steps(off, STEP):
            bucket, first, doc, _ = word_trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            of = np.repeat(doc, np.diff(np.append(first, len(bucket))))
            names = sorted(set(langs[i:j]))
            code = np.array([names.index(x) for x in langs[i:j]], np.int64)
            got = np.bincount(code[of] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for x, row in zip(names, got):
                sums[x] = sums[x] + row if x in sums else row
            if len(sums) > 64:  # many languages: hand over what is there
                yield from out()
                sums.clear()
    yield from out()


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(labelled: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModel:
    """Fits on every row with a non-null lang; trigram counts are summed on the executors.

    To the driver come at most MOST_LANGUAGES x BUCKETS counts; more labels are an error. Rows of null or empty text add
    nothing, and a language without any letters is not learned. Trigrams that no language has count the same for all.
    Repeated rows count each time; other columns are ignored; an empty table gives a model that knows no language."""
    ready(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sums = materialize(rows.mapInArrow(_count_rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    if sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = sums.toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    counts = np.full((BUCKETS, len(names)), PRIOR)
    if names:
        code = {x: i for i, x in enumerate(names)}
        counts[got["bucket"].to_numpy(), [code[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    logp = np.log(counts / counts.sum(0))
    unseen = (counts == PRIOR).all(1)
    if names and unseen.any():
        logp[unseen] = logp[unseen].mean()
    return LanguageModel(names, logp.astype(np.float32))


def _em(ll: np.ndarray, sets: np.ndarray, word_at: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for each text at once. ll: words x k likelihoods relative to the word's best; returns (proportions, log-likelihood)."""
    k = ll.shape[1]
    pi = np.full((len(counts), k), 1.0 / k)
    for _ in range(rounds):
        r = ll * np.repeat(pi, counts, axis=0)
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, word_at, axis=0) / counts[:, None]
        pi = np.maximum(pi, 1e-9)
    return pi, np.add.reduceat(np.log((ll * np.repeat(pi, counts, axis=0)).sum(1)), word_at)


def infer(model: LanguageModel, data: np.ndarray, off: np.ndarray, penalty: float = 1.0, tempering: float = 0.5, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[list[float]]]:
    """(best language index or -1, its score, language set, proportions) per text.

    The score is the language's share of the words times the posterior probability, under equal priors, that it, rather
    than another one alone, stands behind them.
    penalty: of one more language, in units of log(number of words). tempering: exponent of word likelihoods, for
    the dependence of overlapping trigrams."""
    n, count = len(off) - 1, len(model.languages)
    best, score = np.full(n, -1), np.zeros(n)
    sets: list[list[int]] = [[] for _ in range(n)]
    shares: list[list[float]] = [[] for _ in range(n)]
    bucket, first, doc, _ = word_trigrams(data, off)
    if not len(first) or not count:
        return best, score, sets, shares
    ll = np.add.reduceat(model.logp[bucket], first, axis=0) * np.float32(tempering)
    ids, at, words = np.unique(doc, return_index=True, return_counts=True)
    single = np.add.reduceat(ll.astype(np.float64), at, axis=0)
    top = single.argmax(1)
    alive = np.arange(len(ids))
    chosen = [[int(x)] for x in top]
    props = [[1.0] for _ in top]
    value = single[np.arange(len(ids)), top]
    cost = penalty * np.log(np.maximum(words, 2))
    while len(alive) and count > len(chosen[alive[0]]):
        size = len(chosen[alive[0]])
        rows = np.concatenate([np.arange(a, a + w) for a, w in zip(at[alive], words[alive])]) if len(alive) < len(ids) else np.arange(len(ll))
        cnt, w_at = words[alive], np.cumsum(words[alive]) - words[alive]
        have = np.array([chosen[i] for i in alive])
        sub = ll[rows]
        peak = sub.max(1, keepdims=True)
        base = np.add.reduceat(peak[:, 0].astype(np.float64), w_at)
        like = np.exp(sub - peak).astype(np.float64)
        gain, pick, pis = np.full(len(alive), -np.inf), np.full(len(alive), -1), [None] * len(alive)
        for step in range(1, count):  # each language that a text lacks, one after the other
            extra = np.array([[x for x in range(count) if x not in h][step - 1] if step - 1 < count - size else -1 for h in have.tolist()])
            if (extra < 0).all():
                break
            cols = np.concatenate([have, extra[:, None]], 1)
            pi, v = _em(np.take_along_axis(like, np.repeat(cols, cnt, axis=0), 1), cols, w_at, cnt, rounds)
            v = v + base
            better = v > gain
            gain = np.where(better, v, gain)
            pick = np.where(better, extra, pick)
            for i in np.flatnonzero(better):
                pis[i] = pi[i]
        grow = gain - cost[alive] > value[alive]
        for i in np.flatnonzero(grow):
            a = alive[i]
            chosen[a].append(int(pick[i]))
            props[a] = [float(x) for x in pis[i]]
            value[a] = gain[i] - 0.0
        value[alive[grow]] -= cost[alive[grow]]
        alive = alive[grow]
    for k, i in enumerate(ids.tolist()):
        order = sorted(range(len(chosen[k])), key=lambda x: (-props[k][x], chosen[k][x]))
        sets[i], shares[i] = [chosen[k][x] for x in order], [min(1.0, props[k][x]) for x in order]
        best[i] = sets[i][0]
        odds = np.exp(np.delete(single[k], sets[i][1:]) - single[k, best[i]])
        score[i] = shares[i][0] / max(1.0, odds.sum())
    return best, score, sets, shares


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, penalty: float = 1.0) -> DataFrame:
    """docs' columns `keep` (all but clashing ones by default), and lang_pred, score, languages, shares.

    lang_pred is `und`, with score 0, where text is null or has no letter; also where nothing was learned. Repeated rows
    each return a row; an empty table gives an empty result."""
    ready(docs.sparkSession)
    added = {"lang_pred", "score", "languages", "shares"}
    keep = [c for c in docs.columns if c not in added] if keep is None else keep
    text_in = free(keep, "text_in")[0]
    cols = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(text_in))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]] + ["lang_pred string", "score double", "languages array<string>", "shares array<double>"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off, _ = text_buffers(b.column(text_in))
            names, score, sets, shares = [], [], [], []
            for i, j in steps(off, STEP):
                best, s, ids, pis = infer(m, data[off[i] : off[j]], off[i : j + 1] - off[i], penalty)
                names += [m.languages[x] if x >= 0 else UNKNOWN for x in best]
                score += s.tolist()
                sets += [[m.languages[x] for x in y] for y in ids]
                shares += pis
            arrays = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], "lang_pred", "score", "languages", "shares"])

    return cols.mapInArrow(run, schema)
