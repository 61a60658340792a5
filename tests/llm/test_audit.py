"""The filter audit against brute force over all orders."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from martloom.llm import audit, queries


def fails(text):
    w = re.findall("[^\x20\x09-\x0D]+", text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(rows, good, toxic):
    """{(part, order, step): counts}; rows are (doc_id, part, text)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    told = defaultdict(list)
    for i, part, t in rows:
        f = {k for k, bad in fails(t).items() if bad}
        if t in least and i != least[t]:
            f.add("E")
        told[part].append((f, i in good, i in toxic))
    out = {}
    for part, docs in told.items():
        removed_in_all = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_in_all[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in d[0] for d in docs) - len(gone), sum(d[0] == {x} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(removed_in_all[x])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_reach_every_order(n):
    order, seen = list(range(n)), []
    for k in [None, *audit.swaps(n)]:
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_diagram_shares_nodes_and_keeps_counts():
    r = np.random.default_rng(1)
    counts = {m: tuple(r.integers(0, 3, 3).tolist()) for m in range(16)}
    for order, steps in audit.walk("ABCD", counts):
        for at, (name, kept, removed) in enumerate(steps):
            before, bit = sum(1 << "ABCD".index(x) for x in order[:at]), 1 << "ABCD".index(name)
            alive = [(m, c) for m, c in counts.items() if not m & before]
            assert tuple(kept) == tuple(np.sum([c for m, c in alive if not m & bit], 0))
            assert tuple(removed) == tuple(np.sum([c for m, c in alive if m & bit], 0))
    same = audit.Diagram("ABCDE", {m: (1, 0, 0) for m in range(32)})
    assert len(same.children) == 6  # one node a level, one end


def test_audit_of_odd_rows(spark, docs, empty):
    """Nulls, copies across languages, repeated rows, a null doc_id beside its text."""
    long = " ".join(f"w{i}" for i in range(250))
    more = [(20, long, "de"), (21, long, "fr"), (22, long, "de"), (20, long, "de"), (None, long, "fr"),
            (None, "AB # cd", None), (None, "AB # cd", ""), (23, "x " * 300, "de"), (24, None, "de"), (25, "", "fr")]
    rows = spark.createDataFrame(more, "doc_id long, text string, lang string").unionByName(
        docs.select("doc_id", "text", "lang"))
    labels = spark.createDataFrame(
        [(20, 1, 0), (21, 0, 1), (21, 1, None), (23, None, 1), (None, 1, 1), (7, 1, 1), (999, 1, 1)],
        "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost,
                                              r.toxic_lost, r.shapley]
           for r in audit.audit(audit.masks(rows, labels)).collect()}
    want = brute([(r.doc_id, r.lang or "", r.text or "") for r in rows.collect()], {20, 21, 7}, {21, 23, 7})
    assert got == want
    assert audit.audit(audit.masks(empty, labels)).count() == 0


def test_query_has_all_orders(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op13_filter_diagrams(spark, str(tmp_path))
    assert got.count() == 600 * docs.select("lang").distinct().count()
