"""Brute-force miner in plain Python, used only as a test oracle on small
fixtures.  Straight from the definitions (SURVEY §0.1)."""

from collections import defaultdict
from itertools import combinations


def brute_mine(rows, min_util, min_uo_single, min_uo_pair=None, price="actual", exclude=(),
               exclude_when="after_tu", prune="none", duplicates="sum"):
    if duplicates == "keep":
        return _brute_keep(rows, min_util, min_uo_single, min_uo_pair, price, exclude, exclude_when, prune)
    """rows: (tid, item, quantity, unit_price).  Returns (singles, pairs) dicts
    keyed by item / (item1, item2) with (total_util, avg_uo, support)."""
    pair_uo = min_uo_single if min_uo_pair is None else min_uo_pair
    rows = [r for r in rows if r[2] > 0 and r[3] > 0]
    if price == "mean":
        acc = defaultdict(list)
        for _, i, _, p in rows:
            acc[i].append(p)
        mean = {i: sum(v) / len(v) for i, v in acc.items()}
        util_rows = [(t, i, q * mean[i]) for t, i, q, _ in rows]
    else:
        util_rows = [(t, i, q * p) for t, i, q, p in rows]
    if exclude and exclude_when == "before_tu":
        util_rows = [r for r in util_rows if r[1] not in exclude]
    iu = defaultdict(float)
    for t, i, u in util_rows:
        iu[(t, i)] += u
    tu = defaultdict(float)
    for (t, _), u in iu.items():
        tu[t] += u
    entries = {k: v for k, v in iu.items() if tu[k[0]] > 0}
    if exclude and exclude_when == "after_tu":
        entries = {k: v for k, v in entries.items() if k[1] not in exclude}
    by_item = defaultdict(list)
    by_tid = defaultdict(dict)
    for (t, i), u in entries.items():
        by_item[i].append((u, u / tu[t]))
        by_tid[t][i] = u
    singles_all = {
        i: (sum(u for u, _ in v), sum(o for _, o in v) / len(v), len(v)) for i, v in by_item.items()
    }
    singles = {i: s for i, s in singles_all.items() if s[0] >= min_util and s[1] >= min_uo_single}
    allowed = set(singles) if prune == "winners" else set(by_item)
    acc2 = defaultdict(list)
    for t, items in by_tid.items():
        for a, b in combinations(sorted(x for x in items if x in allowed), 2):
            s = items[a] + items[b]
            acc2[(a, b)].append((s, s / tu[t]))
    pairs = {}
    for k, v in acc2.items():
        tot = sum(s for s, _ in v)
        avg = sum(o for _, o in v) / len(v)
        if tot >= min_util and avg >= pair_uo:
            pairs[k] = (tot, avg, len(v))
    return singles, pairs


def _brute_keep(rows, min_util, min_uo_single, min_uo_pair, price, exclude, exclude_when, prune):
    """Every line is its own entry; a repeated pair counts m*n times."""
    pair_uo = min_uo_single if min_uo_pair is None else min_uo_pair
    rows = [r for r in rows if r[2] > 0 and r[3] > 0]
    if price == "mean":
        acc = defaultdict(list)
        for _, i, _, p in rows:
            acc[i].append(p)
        mean = {i: sum(v) / len(v) for i, v in acc.items()}
        lines = [(t, i, q * mean[i]) for t, i, q, _ in rows]
    else:
        lines = [(t, i, q * p) for t, i, q, p in rows]
    if exclude and exclude_when == "before_tu":
        lines = [r for r in lines if r[1] not in exclude]
    tu = defaultdict(float)
    for t, _, u in lines:
        tu[t] += u
    lines = [r for r in lines if tu[r[0]] > 0]
    if exclude and exclude_when == "after_tu":
        lines = [r for r in lines if r[1] not in exclude]
    by_item = defaultdict(list)
    by_tid = defaultdict(list)
    for t, i, u in lines:
        by_item[i].append((u, u / tu[t]))
        by_tid[t].append((i, u))
    singles_all = {
        i: (sum(u for u, _ in v), sum(o for _, o in v) / len(v), len(v)) for i, v in by_item.items()
    }
    singles = {i: s for i, s in singles_all.items() if s[0] >= min_util and s[1] >= min_uo_single}
    allowed = set(singles) if prune == "winners" else set(by_item)
    acc2 = defaultdict(list)
    for t, entries in by_tid.items():
        for (a, ua), (b, ub) in combinations(entries, 2):
            if a == b or a not in allowed or b not in allowed:
                continue
            key = (a, b) if a < b else (b, a)
            acc2[key].append((ua + ub, (ua + ub) / tu[t]))
    pairs = {}
    for k, v in acc2.items():
        tot = sum(s for s, _ in v)
        avg = sum(o for _, o in v) / len(v)
        if tot >= min_util and avg >= pair_uo:
            pairs[k] = (tot, avg, len(v))
    return singles, pairs
