import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from notemill.llm import pitman_yor
from notemill.llm import restaurants as r

from .test_duplicates_and_leaks import prose


def test_seatings_follow_the_exact_posterior():
    """Frequencies of (tables of dish 1, tables of dish 2) in one restaurant, and of another beside it."""
    d, s, p, c = 0.6, 1.5, np.array([0.3, 0.05, 0.2]), np.array([3, 4, 2])
    rising = lambda x, step, n: math.prod(x + step * i for i in range(n))
    stirling = np.exp(r.log_stirling(d))
    want = {(i, j): stirling[3, i] * stirling[4, j] * rising(s, d, i + j) * p[0] ** i * p[1] ** j for i in (1, 2, 3) for j in (1, 2, 3, 4)}
    total = sum(want.values())
    rng, t, found, copies = np.random.default_rng(3), np.ones(3 * 500, int), collections.Counter(), 500
    where = (np.array([0, 0, 1]) + 2 * np.arange(copies)[:, None]).reshape(-1)
    for sweep in range(300):
        t = r.resample(rng, np.tile(c, copies), t, where, 2 * copies, np.tile(p, copies), d, s, np.arange(3 * copies))
        if sweep >= 20:
            found.update(map(tuple, t.reshape(-1, 3)[:, :2].tolist()))
    for key, weight in want.items():
        assert abs(found[key] / found.total() - weight / total) < 0.01
    two = [stirling[2, k] * rising(s, d, k) * p[2] ** k for k in (1, 2)]
    assert abs((t.reshape(-1, 3)[:, 2] == 2).mean() - two[1] / sum(two)) < 0.06


@pytest.mark.parametrize("discount", [0.5, 0.8])
def test_tables_of_many_customers(discount):
    size, s = 400, np.full(402, -np.inf)
    s[0] = 0
    with np.errstate(divide="ignore"):
        for c in range(size):
            s = np.logaddexp(np.log(np.maximum(c - discount * np.arange(402), 0)) + s, np.append(-np.inf, s[:-1]))
    for x in (0.05, 1.0, 20.0):
        w = s[1 : size + 1] + np.arange(1, size + 1) * math.log(x)
        w = np.exp(w - w.max())
        mean = (w * np.arange(1, size + 1)).sum() / w.sum()
        got = r.draw_tables(np.random.default_rng(1), np.full(20000, size), np.full(20000, x), discount).mean()
        assert abs(got - mean) < 0.04 * mean


def test_parameters_are_found_again():
    """Restaurants seated by the process itself; the sampled discount and strength are near those of the process."""
    rng, d, s = np.random.default_rng(4), 0.7, 2.0
    c, where = [], []
    for k in range(400):
        tables = []
        for i in range(40):
            u = rng.random() * (s + i)
            for j, size in enumerate(tables):
                u -= size - d
                if u < 0:
                    tables[j] += 1
                    break
            else:
                tables.append(1)
        c += tables
        where += [k] * len(tables)
    got = r.sample_parameters(rng, r.likelihoods(np.array(c), np.ones(len(c), int), np.array(where), 400))
    assert abs(got[0] - d) < 0.11 and 0.9 < got[1] < 5.1


def test_packed_numbers():
    for a in (np.zeros(0, np.int64), np.array([0, 1, 255, 256, 70000, 1 << 40]), np.arange(5)):
        assert (pitman_yor.unpack(pitman_yor.pack(a)) == a).all() and (pitman_yor.unpack_ascending(pitman_yor.pack_ascending(a)) == a).all()


@pytest.mark.parametrize("starts", [1, 4])
def test_triples_of_a_block(monkeypatch, starts):
    """Against plain counting, with a word of several classes."""
    texts, held, numbers = [[0, 1, 0, 1, 0], [], [1], [0, 0]], np.array([False, False, True, False]), np.array([5, 7, 9])
    n = np.array([len(x) for x in texts])
    hot = {0: pitman_yor.MOST * 3, 1: pitman_yor.MOST + 1}
    row = {
        "n_words": pitman_yor.pack(n), "tokens": pitman_yor.pack(np.array([w for x in texts for w in x])), "held": held.tobytes(), "hot": pitman_yor.pack(np.array(list(hot))),
        "hot_counts": pitman_yor.pack(np.array(list(hot.values()))), "end": 2, "end_count": 4, "numbers": pitman_yor.pack_ascending(numbers), "unknown": pitman_yor.pack_ascending(np.array([1])),
    }
    # first tokens have the class of their number modulo starts, 5 and 9 here; 7 is unknown
    of_class = {5: 5 % starts, 7: 0, 9: 9 % starts}
    triples = lambda places: pitman_yor.Triples(row, 3, places, pitman_yor.MOST, starts)
    b, places, want = triples(False), triples(True), collections.Counter()
    for x, out in zip(texts, held, strict=True):
        seq = [*numbers[x].tolist(), 9]
        for i, w in enumerate(seq):
            key = (9, of_class[w]) if i == 0 else (seq[i - 1], 9 if i == 1 else seq[i - 2])
            want[(*key, w)] += not out
    of = np.repeat(np.arange(len(b.before)), b.per_context)
    got = {(int(b.parent_word[b.context_parent[c]]), int(b.before[c]), int(w)): int(k) for c, w, k in zip(of, b.token, b.counts, strict=True)}
    monkeypatch.setattr(pitman_yor, "KEY_BITS", 4)
    again = triples(True)
    for name in ("token", "before", "counts", "at", "per_context", "per_parent", "cut"):
        assert (getattr(again, name) == getattr(places, name)).all()
    asks = [dict(zip([c.split()[0] for c in pitman_yor._ASKS.split(", ")], x, strict=True)) for x in b.asks(0)]
    shards = []
    for bits in (4, 62):
        monkeypatch.setattr(pitman_yor, "KEY_BITS", bits)
        shards.append([pitman_yor.Shard([x], 9) for x in asks])
    for one, two in zip(*shards, strict=True):
        assert (one.c2 == two.c2).all() and (one.of == two.of).all() and (one.up == two.up).all() and (one.restaurant2 == two.restaurant2).all()
    assert got == dict(want) and b.cut[-1] == len(want) and (b.keys == places.keys).all() and (b.counts == places.counts).all()
    assert (places.token[places.at] == [w for x in texts for w in [*numbers[x].tolist(), 9]]).all()
    assert all(k < (starts if w == 9 else pitman_yor.classes(np.int64(hot.get({5: 0, 7: 1}.get(int(w)), 1)), pitman_yor.MOST)) for w, k in zip(b.parent_word, b.parent_class, strict=True))


def test_longer_contexts_count(spark, docs):
    """After x y comes p, after z y comes q; held-out texts that follow the rule are likelier."""
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    train = [(k, "x y p" if k % 2 else "z y q") for k in range(2000) if not held(k)]
    ids = [k for k in range(3000, 4000) if held(k)][:4]
    got = {x.doc_id: x.score for x in pitman_yor.score(spark, docs([*train, *zip(ids, ["x y p", "z y q", "x y q", "z y p"], strict=True)])).collect()}
    assert min(got[ids[0]], got[ids[1]]) > max(got[ids[2]], got[ids[3]]) + 1


def test_language_model_scores(spark, docs, odd_rows):
    rng = random.Random(6)
    vocabulary = prose(rng, 80).split()
    rows = [*odd_rows, *((100 + k, " ".join(x for _ in range(20) for x in (rng.choice(vocabulary[:40]), rng.choice(vocabulary[40:])))) for k in range(120))]
    got = pitman_yor.score(spark, docs(rows).repartition(3)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = [(i, [*(x or "").encode().translate(lower).split(), b"</end>"]) for i, x in rows]
    c = collections.Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    some = [r for r in got if r.held_out and (r.doc_id or 0) >= 100]
    assert some and sum(r.score for r in some) > sum(r.base_score for r in some)
    assert pitman_yor.score(spark, docs([])).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    rng, found = random.Random(9), []
    vocabulary = prose(rng, 60).split()
    table = docs([(k, " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for k in range(150)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(pitman_yor, "SHARD_TOKENS", 300)
        monkeypatch.setattr(pitman_yor, "RANGE_TOKENS", 700)
        for parts in (1, 2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append({r.doc_id: round(r.score, 8) for r in pitman_yor.score(spark, table.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 150 and found[0] == found[1] == found[2]


@pytest.mark.parametrize(("most", "range_tokens"), [(pitman_yor.MOST, 20_000_000), (40, 20_000_000), (40, 150)])
def test_probabilities_add_up_to_one(spark, docs, monkeypatch, most, range_tokens):
    """Over all texts of at most six tokens of a known vocabulary and one unknown word; longer ones are rare in training. With many more
    texts than MOST, first tokens have classes."""
    monkeypatch.setattr(pitman_yor, "RANGE_TOKENS", range_tokens)
    rng, held = random.Random(5), lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    train = [(k, " ".join(rng.choices("ab", k=rng.randrange(3)))) for k in range(400) if not held(k)]
    texts = [" ".join(p) for n in range(7) for p in itertools.product(["a", "b", "zz"], repeat=n)]
    ids = [k for k in range(1000, 20000) if held(k)][: len(texts)]
    got = pitman_yor.score(spark, docs([*train, *zip(ids, texts, strict=True)]), most=most).where("held_out and doc_id >= 1000").collect()
    assert len(got) == len(texts) and 0.99 < sum(10**r.score for r in got) <= 1 + 1e-9


def test_classes_of_first_tokens_change_little(spark, docs):
    """Scores with many classes are those without within sampling error, also of texts that differ in length alone."""
    rng, held = random.Random(4), lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    vocabulary = [f"w{k}" for k in range(30)]
    train = [(k, " ".join(rng.choices(vocabulary[: 1 + k % 30], k=1 + k % 3))) for k in range(1500) if not held(k)]
    ids = [k for k in range(3000, 9000) if held(k)][:40]
    table = docs([*train, *((k, " ".join(rng.choices(vocabulary, k=1 + k % 4))) for k in ids)])
    few, many = ({r.doc_id: r.score for r in pitman_yor.score(spark, table, most=most).where("doc_id >= 3000").collect()} for most in (10**6, 100))
    assert max(abs(few[k] - many[k]) for k in ids) < 0.5 and abs(sum(few.values()) - sum(many.values())) < 0.05 * len(ids)


def test_stirling_numbers_of_any_size(monkeypatch):
    for d in (0.1, 0.6, 0.95):
        at = {(65, t): r.log_stirling_at(np.array([65]), np.array([t]), d)[0] for t in (1, 2, 10, 40, 55, 64, 65)} | {(300, t): r.log_stirling_at(np.array([300]), np.array([t]), d)[0] for t in (1, 2, 30, 250, 299, 300)}
        with monkeypatch.context() as m:
            m.setattr(r, "EXACT", 300)
            table = r.log_stirling.__wrapped__(d)
        assert all(abs(table[k] - v) < 1e-6 for k, v in at.items())


def test_likelihoods_have_restaurants_with_frequent_dishes(monkeypatch):
    c, t, where = np.array([3, 200, 1, 90, 7]), np.array([1, 12, 1, 3, 2]), np.array([0, 0, 1, 1, 2])
    got = r.likelihoods(c, t, where, 3)
    monkeypatch.setattr(r, "EXACT", 200)
    monkeypatch.setattr(r, "log_stirling", r.log_stirling.__wrapped__)
    assert np.allclose(got, r.likelihoods(c, t, where, 3), atol=1e-5)


def test_tables_of_frequent_dishes_have_their_exact_distribution():
    rng, n, d = np.random.default_rng(3), 20_000, 0.6
    for c, x in ((70, 0.05), (300, 2.0)):
        t = np.arange(1, c + 1)
        p = r.log_stirling_at(np.full(c, c), t, d) + t * np.log(x)
        p = np.exp(p - p.max())
        drawn = r.draw_tables(rng, np.full(n, c), np.full(n, x), d)
        again = r.draw_tables(rng, np.full(n, c), np.full(n, x), d, drawn)
        for sample in (drawn, again):
            assert np.abs(np.bincount(sample, minlength=c + 1)[1:] / n - p / p.sum()).sum() < 0.05


def test_stirling_integral_takes_few_points_where_they_do(monkeypatch):
    rng, points = np.random.default_rng(3), []
    c = np.exp(rng.uniform(np.log(65), np.log(1e5), 2000)).astype(int)
    t = np.concatenate([np.maximum(2, (c[:1600] ** rng.uniform(0, 1, 1600)).astype(int)), c[1600:] - rng.integers(1, 9, 400)])
    integral = r._integral
    monkeypatch.setattr(r, "_integral", lambda *a: points.append(len(a[0]) * a[-1]) or integral(*a))
    for d in (0.1, 0.5, 0.8, 0.95):
        points.clear()
        got = r.log_stirling_at(c, t, d)
        assert sum(points) < r.NODES * len(c) / 2
        with monkeypatch.context() as m:
            m.setattr(r, "SAME", -1.0)  # all points for all
            assert np.abs(got - r.log_stirling_at(c, t, d)).max() < 1e-5
