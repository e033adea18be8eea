"""Sequential selection on arrays of one request: ids and costs, never texts."""

from __future__ import annotations

import math

import numpy as np

KNAPSACK_MOST, COMMUNITY_BONUS = 256, 0.4
AUTO_ROWS, AUTO_TOKENS = 3, 50


def slack_of(budget: int) -> int:
    return math.ceil(budget * 0.05)


def greedy(costs: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """(kept, dropped) in rank order: what fits stays; the first row that only fits in the slack ends the pass, and
    rows behind it are neither kept nor counted as dropped."""
    kept, used, dropped, most = np.zeros(len(costs), bool), 0, 0, budget + slack_of(budget)
    for i, c in enumerate(costs.tolist()):
        if used + c > most:
            dropped += 1
            continue
        kept[i] = True
        used += c
        if used > budget:
            break
    return kept, dropped


def knapsack(costs: np.ndarray, budget: int) -> np.ndarray:
    """The set of most value, 1 / (1 + rank) a row, within the budget; ties leave later rows out.

    One row of values is kept, and a bit for each row and budget says whether the row raises it."""
    weight = np.maximum(costs, 1)
    value = 1.0 / (1.0 + np.arange(len(costs)))
    room = int(min(budget, weight.sum()))
    best, taken = np.zeros(room + 1), np.zeros((len(costs), room // 8 + 1), np.uint8)
    for i, (w, v) in enumerate(zip(weight.tolist(), value.tolist())):
        if w <= room:
            new = best.copy()
            np.maximum(new[w:], best[: room + 1 - w] + v, out=new[w:])
            taken[i] = np.packbits(new > best + 1e-12)
            best = new
    kept = np.zeros(len(costs), bool)
    for i in range(len(costs) - 1, -1, -1):
        if taken[i, room >> 3] >> (7 - (room & 7)) & 1:
            kept[i] = True
            room -= int(weight[i])
    return kept


def mmr(costs: np.ndarray, budget: int, features: list[np.ndarray], trade: float = 0.7, community: np.ndarray | None = None) -> np.ndarray:
    """Repeatedly the row of most trade * relevance + (1 - trade) * share of new lines + bonus for a new community.

    features: distinct line numbers of each row. community: label or -1; None where communities don't count. Counts
    of uncovered lines are kept up by an inverted list, so a pick costs one pass over the rows."""
    n = len(costs)
    weight, most = np.maximum(costs, 1), budget + slack_of(budget)
    trade = min(max(trade, 0.0), 1.0)
    relevance = trade / (1.0 + np.arange(n))
    size = np.array([len(f) for f in features], np.int64)
    flat = np.concatenate(features) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    lines, first = np.unique(flat[order], return_index=True)
    end = np.append(first[1:], len(flat))
    universe = max(1, len(lines))
    fresh, covered = size.copy(), np.zeros(len(lines), bool)
    labels = np.unique(community[community >= 0]) if community is not None else np.zeros(0, np.int64)
    bonus = np.zeros(n)
    if len(labels):
        bonus[community >= 0] = COMMUNITY_BONUS * (1.0 / len(labels))
    free, used = np.ones(n, bool), 0
    while True:
        open_rows = np.flatnonzero(free & (used + weight <= most))
        if not len(open_rows):
            break
        score = relevance[open_rows] + (1.0 - trade) * (fresh[open_rows] / universe) + bonus[open_rows]
        i = int(open_rows[np.argmax(score)])
        free[i] = False
        used += int(weight[i])
        for x in np.searchsorted(lines, features[i]).tolist():
            if not covered[x]:
                covered[x] = True
                fresh[owner[order[first[x] : end[x]]]] -= 1
        if len(labels) and community[i] >= 0:
            bonus[community == community[i]] = 0.0
        if used >= budget:
            break
    return ~free


def select(strategy: str, costs: np.ndarray, budget: int, features, trade: float, community) -> tuple[np.ndarray, int, str]:
    """(kept, dropped, label) of one request's rows in rank order; features is called only where lines matter."""
    n = len(costs)
    if budget == 0:
        return np.zeros(n, bool), n, "zero_budget"
    if strategy == "auto":
        strategy = "mmr_submodular" if n >= AUTO_ROWS and budget > AUTO_TOKENS else "greedy"
    if strategy == "knapsack_dp" and n > KNAPSACK_MOST:
        strategy = "greedy"
    if n == 0 and strategy != "greedy":
        return np.zeros(0, bool), 0, f"{strategy}_empty"
    if strategy == "greedy":
        kept, dropped = greedy(costs, budget)
    else:
        kept = knapsack(costs, budget) if strategy == "knapsack_dp" else mmr(costs, budget, features(), trade, community)
        dropped = n - int(kept.sum())
    return kept, dropped, strategy
