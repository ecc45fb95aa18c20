import collections
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import decontaminate, near_dedup

from .conftest import chunk


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n))


def changed(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(999))
    return " ".join(words)


def brute_components(rows):
    def shingles(x):
        w = (x or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = {i: shingles(x) for i, x in rows}, {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.mark.parametrize("block", [1024, 7])
def test_components_equal_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(11)
    passage, rows = prose(rng, 60), []
    for k in range(25):
        base = prose(rng, rng.choice([3, 4, 5, 12, 80, 200]))
        for _ in range(rng.randrange(1, 6)):
            rows.append(changed(rng, base, rng.randrange(0, 2 + len(base.split()) // 60)))
    rows += [passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(40)]
    base = prose(rng, 150)
    rows += [changed(rng, base, 3) for _ in range(60)] + [base] * 5 + ["", None, "  ", "One Two", "one two"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark, docs(rows).repartition(3)).collect()}
    want = brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_odd_rows_and_empty_tables(spark, docs, odd_rows):
    got = [tuple(r) for r in near_dedup.near_duplicates(spark, docs(odd_rows)).collect()]
    assert len(got) == len(odd_rows) and (None, 1, None, True) in got and got.count((4, 1, 4, True)) == 2 and (2, 0, 2, True) in got
    assert near_dedup.near_duplicates(spark, docs([])).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark, docs):
    rng = random.Random(2)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [(3, one), (5, two), (7, one + " x"), (7, two + " y"), (7, prose(rng, 40)), (None, two + " z"), (None, one), (8, prose(rng, 30))]
    got = sorted((str(r.doc_id), r.component_id) for r in near_dedup.near_duplicates(spark, docs(rows)).collect())
    assert got == sorted([("3", 3), ("5", 5), ("7", 3), ("7", 5), ("7", 7), ("None", 5), ("None", 3), ("8", 8)])
    extra = docs(rows + [(8, rows[-1][1]), (9, None), (9, None)]).withColumns({"s1": F.lit("a"), "class_id": F.lit("b"), "node": F.lit(1), "k_id": F.lit(1)})
    left = near_dedup.filter_documents(spark, extra)
    assert left.columns == extra.columns
    want = [(3, one), (5, two), (7, rows[4][1]), (8, rows[-1][1]), (9, None), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)


def test_estimates_are_close():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.75, 0.9):
        n = 400
        common = rng.integers(0, 2**63, int(n * share), np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), np.uint64)])) for _ in range(2)]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        reg = near_dedup.sketch(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        got = near_dedup.estimate(np.array([(reg[0] == reg[1]).sum()]), np.array([n]), np.array([n]))[0]
        assert abs(got - true) < 0.15


def test_chain_components(spark):
    from notemill.llm.scratch import Scratch

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(Scratch(spark, "cc"), edges, "x").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


ITEMS = [(k, prose(random.Random(1000 + k), 30)) for k in range(30)]


def test_wand_equals_exhaustive_scoring():
    index = decontaminate.build(decontaminate.cut_items([(i, x, None) for i, x in ITEMS]))
    rng = random.Random(8)
    for _ in range(40):
        words = " ".join(rng.sample(" ".join(x for _, x in rng.sample(ITEMS, 3)).split(), 40))
        t = chunk([words], lower=True)
        terms = np.unique(index.lookup(t.hash))
        terms = terms[terms >= 0]
        want = collections.Counter()
        for term in terms:
            for k in range(index.first[term], index.first[term + 1]):
                want[int(index.items[k])] += float(index.shares[k])
        for threshold in (0.2, 0.4):
            got = dict(decontaminate.wand(index, terms, threshold))
            assert set(got) == {i for i, v in want.items() if v >= threshold - 1e-9}
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks(spark, docs, odd_rows):
    rng = random.Random(3)
    clean = [(500 + k, prose(rng, 300)) for k in range(10)]
    leaked = [(600 + k, prose(rng, rng.randrange(400)) + " " + ITEMS[k][1].upper() + " " + prose(rng, 50)) for k in range(20)]
    half = [(700, prose(rng, 50) + " " + " ".join(ITEMS[25][1].split()[:10]))]
    table = docs([*odd_rows, *clean, *leaked, *half])
    bench = spark.createDataFrame([*ITEMS, (99, None), (98, "")], "item_id long, text string")
    idx = decontaminate.indexes(bench)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, idx).collect()} == {(600 + k, k) for k in range(20)}
    kept = decontaminate.filter_documents(table, idx)
    assert kept.count() == table.count() - 20 and kept.columns == table.columns
    assert decontaminate.leaks(table, decontaminate.indexes(bench.limit(0))).count() == 0 and decontaminate.leaks(docs([]), idx).count() == 0


def test_short_items_and_answers(spark, docs):
    rng = random.Random(21)
    items = [(n, " ".join(f"item{n}word{k}" for k in range(n))) for n in range(1, 9)]
    table = docs([(n, f"{prose(rng, 40)} {x} {prose(rng, 40)}") for n, x in items] + [(50, prose(rng, 100)), (51, "item2word1 item2word0 " + prose(rng, 20))])
    for extra in ([], ITEMS):
        idx = decontaminate.indexes(spark.createDataFrame([*items, *extra], "item_id long, text string"))
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, idx).collect()} == {(n, n) for n, _ in items}
    asked = [(n, "what is the capital of country" + str(n) + " today", "city" if n == 1 else "new city") for n in (1, 2)]
    table = docs([(n, f"{prose(rng, 30)} {q} {a} {prose(rng, 30)}") for n, q, a in asked] + [(9, prose(rng, 30) + " " + asked[0][1] + " " + prose(rng, 30))])
    idx = decontaminate.indexes(spark.createDataFrame(asked, "item_id long, text string, reply string"), "reply")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table, idx).collect()}
    assert {(1, 1), (2, 2)} <= got and not any(d == 9 for d, _ in got)


def test_many_items_give_what_one_index_gives(spark, docs, monkeypatch):
    rng = random.Random(6)
    bench = spark.createDataFrame([*ITEMS, ITEMS[0], (None, ITEMS[1][1]), (None, "of no number at all")], "item_id long, text string")
    table = docs([(k, prose(rng, 40) + " " + changed(rng, ITEMS[k % 30][1], k % 9) + " " + prose(rng, 40)) for k in range(60)] + [(None, "say of no number at all"), (None, None)])
    found = []
    for size, scan in ((512, 8), (10, 2)):
        monkeypatch.setattr(decontaminate, "INDEX_ITEMS", size)
        monkeypatch.setattr(decontaminate, "PASS_INDEXES", scan)
        idx = decontaminate.indexes(bench)
        assert len(idx) == (1 if size == 512 else 4)
        found.append(sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in decontaminate.leaks(table, idx).collect()), key=str))
        found.append(sorted(str(r.doc_id) for r in decontaminate.filter_documents(table, idx).collect()))
    assert found[0] == found[2] and found[1] == found[3] and 20 < len(found[0]) and (None, None) in {r[:2] for r in found[0]} and {(1, 1), (1, None)} <= {r[:2] for r in found[0]}


def test_the_driver_forgets_finished_steps_of_near_duplicates(spark):
    known = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[: 40 + k % 12]) + f" x{k // 24}") for k in range(120)], "doc_id long, text string")
    before, rows = known().size(), near_dedup.classes(spark, docs)
    for _ in range(40):  # Spark clears them in a thread of its own
        left = known().size() - before
        if left < 20:
            break
        time.sleep(0.5)
    assert left < 20 and rows.count() == 120


def test_no_step_of_near_duplicates_has_a_plan_of_many_shuffles(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rng = random.Random(3)
    passage = prose(rng, 60)
    table = docs([(k, passage + " " + prose(rng, rng.randrange(5, 60))) for k in range(60)])
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    known = store.executionsCount()
    assert near_dedup.near_duplicates(spark, table).count() == 60
    bus.waitUntilEmpty(30_000)
    done = store.executionsList()
    plans = [done.apply(k).physicalPlanDescription() for k in range(known, done.size())]
    counts = [len(re.findall(r"^\(\d+\) Exchange", x, re.M)) for x in plans]
    assert len(counts) > 9 and max(counts) <= 7, counts
