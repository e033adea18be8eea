import hashlib
import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.model import CHUNK, Config
from loomspark.operators import budget, compress, dedup, kernels, pipeline, ranking


def chunks(spark, texts, **more):
    rows = [(f"c{i}", i, f"p{i}.x", more.get("language", "unknown"), t, more.get("kind", "code"), 0, more.get("hint", False), None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


def ids(df, col="pos"):
    return sorted(r[0] for r in df.select(col).collect())


def test_exact_dedup_ignores_spacing(spark):
    assert ids(dedup.exact_dedup(chunks(spark, ["a  b", "a b ", "c"]))) == [0, 2]


def test_items_are_worked_on_in_slices(monkeypatch):
    lists = [[f"w{i % 50}x{j}" for j in range(i % 9)] for i in range(200)] + [None]
    b = pa.RecordBatch.from_pydict({"pos": list(range(201)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    whole = pa.Table.from_batches(dedup._simhash_rows(iter([b])))
    monkeypatch.setattr(dedup, "SLICE_ITEMS", 20)
    parts = list(dedup._simhash_rows(iter([b])))
    assert len(parts) > 20 and pa.Table.from_batches(parts).to_pydict() == whole.to_pydict()


def test_signature_is_the_least_of_each_permutation(spark):
    texts = ["\n".join(f"l{(i * 7 + j) % 31}" for j in range(i)) for i in range(12)]
    got = {r.pos: r.sig for r in dedup.minhash(chunks(spark, texts), 1).collect()}
    for i, text in enumerate(texts):
        words = [np.frombuffer(hashlib.md5(x.encode()).digest()[:8], ">u4").astype(int) for x in text.split("\n") if x]
        assert got[i] == [min([(int(a) + k * max(int(c), 1)) % dedup.PRIME for a, c in words], default=dedup.PRIME) for k in range(dedup.PERMUTATIONS)]


def test_first_keep_is_not_components(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (4, 5), (5, 6)], "a long, b long")
    assert ids(dedup.first_keep(pairs)) == [1, 4, 6]


def test_simhash_reorder_and_tiny(spark):
    a = "alpha beta gamma delta epsilon zeta"
    assert ids(dedup.simhash_dedup(chunks(spark, [a, " ".join(reversed(a.split())), "x1 y1", "x1 y2"]))) == [0, 2, 3]


def test_members_give_back_the_links_of_all_rows(spark):
    a = " ".join(f"word{i}" for i in range(30))
    c = chunks(spark, [a, " ".join(reversed(a.split())), a + "  ", "x1 y1", "x1 y2"])
    assert sorted(tuple(r) for r in dedup.members(c).collect()) == [(0, 0, 0), (1, 1, 0), (2, 0, 0), (3, 3, 3), (4, 4, 4)]


def test_line_jaccard_threshold_is_single_precision(spark):
    base = [f"line {i}" for i in range(24)]
    texts = ["\n".join(base), "\n".join([*base[:-1], "other"]), "\n".join(base[:23] + ["x", "y"])]
    assert ids(dedup.jaccard_dedup(chunks(spark, texts), 23 / 25)) == [0, 2]
    assert ids(dedup.jaccard_dedup(chunks(spark, texts))) == [0, 1, 2]  # 23/25 is below the widened 0.92


def test_cascade_branches(spark):
    many = chunks(spark, ["\n".join([f"shared line number {i}" for i in range(25)] + [f"unique {k}"]) for k in range(100)])
    got, s = dedup.dedup(many, 0.85)
    assert s.before - s.after > 80 and s.after == got.count()
    one = "\n".join(f"row {i} of the text" for i in range(30))
    got, s = dedup.dedup(chunks(spark, [one, one + "\none more"]), 0.9)
    assert s.after == 1 and not s.used_lsh


def test_boilerplate(spark):
    long = "this is a licence line that repeats"
    d = chunks(spark, [f"{long}\nbody {i}\nshort" for i in range(4)])
    got = {r.pos: r.content for r in compress.collapse_boilerplate(d).collect()}
    assert got[0].startswith(long) and got[1] == "body 1\nshort"
    three = chunks(spark, [f"{long}\nbody {i}" for i in range(3)])
    assert all(r.content.startswith(long) for r in compress.collapse_boilerplate(three).collect())
    notes = chunks(spark, [f"{long}\nbody {i}" for i in range(4)], kind="comment")
    assert all(r.content.startswith(long) for r in compress.collapse_boilerplate(notes).collect())
    edge = chunks(spark, ["x" * 23 + f"\nq{i}\n" + "y" * 24 for i in range(4)])
    assert {r.pos: r.content for r in compress.collapse_boilerplate(edge).collect()}[1] == "x" * 23 + "\nq1"


def test_count_min():
    s = compress.CountMin()
    s.add("a", 100), s.add("b", 3)
    t = compress.CountMin()
    t.add("a", 5)
    s.merge(t)
    assert s.count("a") >= 105 and s.count("b") >= 3 and s.count("zz") <= 1 and s.total == 108 and (s.rows, s.cols) == (10, 2719)


def test_ranking(spark):
    d = chunks(spark, ["parse the token stream", "render image pixels", "network socket loop"])
    got = {r.pos: r["rank"] for r in ranking.rank(d, "token").select("pos", "rank").collect()}
    assert got[0] == 1 and sorted(got.values()) == [1, 2, 3]
    c = ranking.Corpus(d)
    score = lambda q: {r.pos: r.score for r in ranking.bm25(c, ranking.query_terms(spark, q)).collect()}
    assert score("token token")[0] == pytest.approx(2 * score("token")[0], abs=1e-9) and set(score("").values()) == {0.0}
    assert ids(ranking.expand_raw_query(c, "zebra"), "t") == ["zebra"]
    terms = {r.t: r.times for r in ranking.expand_raw_query(c, "token").collect()}
    assert terms["token"] == 10 and terms["stream"] == 4


def test_rounds_halves_as_sql_does(spark):
    values = [round(k * 1e-9 + 5e-10, 12) for k in range(1, 20000, 7)]
    want = duckdb.connect().execute(f"SELECT round(unnest({values}::DOUBLE[]), 9)").fetchall()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").orderBy("i").select(T.round_binary(F.col("x"), 9)).collect()
    assert [r[0] for r in got] == [r[0] for r in want]


def test_equal_tokens_score_equally_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DIGITS", 15)  # so that a difference in the last bit shows
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(300):
        own = list(rng.choice(words, 150))
        texts += [" ".join(own), " ".join(rng.permutation(own))]
    got = [r.score for r in ranking.density(ranking.Corpus(chunks(spark, texts))).orderBy("pos").collect()]
    assert got[::2] == got[1::2]


def test_fusion_and_priors(spark):
    pair = chunks(spark, ["alpha beta", "gamma delta"])
    prior = spark.createDataFrame([("c1", 1.0)], "id string, prior double")
    got = {r.pos: r.score for r in ranking.rank(pair, None, prior).collect()}
    assert got[0] == pytest.approx(1.5 / 61 + 1.0 / 62) and got[1] == pytest.approx(1.5 / 62 + 1.0 / 61) and got[0] > got[1]
    assert ranking.rank(chunks(spark, ["one"]), "one").first().score == 0.0


def greedy_loop(costs, cap):
    slack, used, kept, dropped = -(-cap * 5 // 100), 0, [], 0
    for i, c in enumerate(costs):
        if used + c <= cap:
            used += c
            kept.append(i)
        elif used + c <= cap + slack:
            kept.append(i)
            break
        else:
            dropped += 1
    return kept, dropped


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=20), st.integers(1, 300))
def test_greedy(costs, cap):
    kept, dropped = kernels.greedy(np.array(costs, np.int64), cap)
    assert (np.flatnonzero(kept).tolist(), dropped) == greedy_loop(costs, cap)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 80))
def test_knapsack_is_optimal(costs, cap):
    kept = kernels.knapsack(np.array(costs, np.int64), cap)
    value = lambda s: sum(1 / (1 + i) for i in s)
    best = max(value(s) for r in range(len(costs) + 1) for s in itertools.combinations(range(len(costs)), r) if sum(costs[i] for i in s) <= cap)
    chosen = np.flatnonzero(kept).tolist()
    assert sum(costs[i] for i in chosen) <= cap and value(chosen) == pytest.approx(best)


def mmr_loop(costs, cap, feats, trade, comm):
    most, used, chosen, seen, done = cap + -(-cap * 5 // 100), 0, [], set(), set()
    universe = max(1, len(set().union(*feats)) if feats else 1)
    labels = {c for c in comm if c >= 0}
    while True:
        best = None
        for i in range(len(costs)):
            if i in chosen or used + max(1, costs[i]) > most:
                continue
            s = trade / (1 + i) + (1 - trade) * (len(feats[i] - seen) / universe) + (0.4 * (1 / len(labels)) if comm[i] >= 0 and comm[i] not in done else 0.0)
            if best is None or s > best[0]:
                best = (s, i)
        if best is None:
            return sorted(chosen)
        chosen.append(best[1])
        used += max(1, costs[best[1]])
        seen |= feats[best[1]]
        done.add(comm[best[1]])
        if used >= cap:
            return sorted(chosen)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.frozensets(st.integers(0, 9), max_size=5), st.integers(-1, 2)), min_size=1, max_size=9), st.integers(1, 120), st.sampled_from([0.0, 0.3, 0.7, 1.0]))
def test_mmr(rows, cap, trade):
    costs, feats, comm = [r[0] for r in rows], [set(r[1]) for r in rows], [r[2] for r in rows]
    got = kernels.mmr(np.array(costs), cap, [np.array(sorted(f), np.int64) for f in feats], trade, np.array(comm))
    assert np.flatnonzero(got).tolist() == mmr_loop(costs, cap, feats, trade, comm)


@pytest.mark.parametrize("costs,cap,kept,dropped", [([100, 60, 40, 3, 1], 150, [0, 2, 3, 4], 1), ([100, 55, 1], 150, [0, 1], 0)])
def test_greedy_slack(costs, cap, kept, dropped):
    got, d = kernels.greedy(np.array(costs), cap)
    assert (np.flatnonzero(got).tolist(), d) == (kept, dropped)


def test_budget_labels(spark):
    d = ranking.rank(chunks(spark, ["alpha " * 30, "beta " * 30, "gamma " * 30]), None)
    for cap, strategy, label in ((1000, "auto", "mmr_submodular"), (40, "auto", "greedy"), (0, "auto", "zero_budget"), (1000, "knapsack_dp", "knapsack_dp")):
        assert budget.select(d, cap, strategy)[1].strategy == label
    assert budget.select(d.limit(0), 100, "knapsack_dp")[1] == budget.BudgetStats(0, 0, 0, "knapsack_dp_empty")


def test_optimize(spark):
    ts = 'export class Pay {\n  // takes money\n  charge(n: number) { console.log("x"); return this.api.post(n, "a long enough string here"); }\n}\n'
    d = chunks(spark, [ts, ts.replace("takes money", "takes  money"), "export function other(a: string) { return a.trim().split(' ').map(x => x.length); }"], language="typescript", hint=True)
    got = pipeline.optimize(d, "other function", Config(cache_order=False))
    assert got.reduction_pct >= 40 and got.final_tokens < got.original_tokens and got.stats["dedup"]["exact_removed"] == 1
    order = [[r.id for r in pipeline.optimize(x, "pay", Config(dedup=False)).chunks.collect()] for x in (d, d.selectExpr("id", "2 - pos as pos", *d.columns[2:]))]
    assert order[0] == order[1]
    assert pipeline.optimize(d.limit(0), "q").final_tokens == 0
