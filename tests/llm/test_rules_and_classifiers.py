import random
import re

import numpy as np
import pytest

from notemill.llm import language_id, quality_classifier, quality_rules
from notemill.llm import textcore as tc

from .conftest import chunk


def brute_base(text):
    b = (text or "").encode()
    words = b.split()
    seen, dup = set(), 0
    for line in b.split(b"\n"):
        if line.split():
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts_equal_brute_force(spark, docs, odd_rows):
    rng = random.Random(3)
    rows = [*odd_rows, *((100 + k, "".join(rng.choice("ab é\n #\t") for _ in range(rng.randrange(200)))) for k in range(60))]
    got = quality_rules.quality_rules(docs(rows), quality_rules.ALL_CONTENT).collect()
    key = lambda r: (str(r[0]), r[1:])
    want = []
    for i, x in rows:
        b = brute_base(x)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((i, *b, failed, not failed))
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(want, key=key)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        gain, trans = rng.normal(0, 2, n), rng.normal(0, 2, (2, 2))
        begins = np.zeros(n, bool)
        begins[0] = True
        score = lambda y: sum(g for g, k in zip(gain, y, strict=True) if k) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(score(tuple(k >> j & 1 for j in range(n))) for k in range(2**n))
        assert abs(score(tuple(quality_rules.viterbi(gain, begins, trans))) - best) < 1e-9


CLEAN = ["The small house stands near the river and people walk there often in summer.", "We read old books about ships, storms and long journeys to the north."]
JUNK = ["BUY### NOW&&& cheap$$$ offer%%% click*** here||| more### deals$$$", "free*** win&&& prize### $$$ %%% ||| <<< >>> ***"]


def labelled(n=60, seed=1):
    rng = random.Random(seed)
    good = [("\n".join(" ".join(rng.sample(rng.choice(CLEAN).split(), 9)) for _ in range(8)), 1) for _ in range(n)]
    bad = [("\n".join(" ".join(rng.sample(rng.choice(JUNK).split(), 7)) for _ in range(8)), 0) for _ in range(n)]
    return good + bad


def test_line_field_learns():
    field = quality_rules.train(labelled())
    share = lambda text: quality_rules.judge(chunk([text]), field, 0.5)[2][0]
    assert all((share(x) > 0.5) == bool(y) for x, y in labelled(20, 9))
    assert quality_rules.train([("only good", 1)]) is quality_rules.ALL_CONTENT and quality_rules.train([]) is quality_rules.ALL_CONTENT


def test_classifier_learns_and_is_calibrated():
    model = quality_classifier.train(labelled())
    test = labelled(30, 7)
    score = model.score(chunk([x for x, _ in test]))
    y = np.array([k for _, k in test])
    assert ((score >= quality_classifier.THRESHOLD) == y).mean() > 0.95 and ((score >= 0) & (score <= 1)).all()
    assert quality_classifier.train([]).score(chunk(["x"]))[0] == 0.5


def test_filters_on_odd_tables(spark, docs, odd_rows):
    model = quality_classifier.train(labelled())
    table = docs(odd_rows).withColumnsRenamed({"source": "score"})  # a clashing name passes through
    assert quality_classifier.classify(table, model).count() == len(odd_rows)
    assert quality_classifier.filter_documents(table, model).columns == table.columns
    assert quality_rules.filter_documents(table, quality_rules.ALL_CONTENT).count() == 0
    assert quality_rules.filter_documents(docs([(1, " ".join(f"w{k}" for k in range(60)))]), quality_rules.ALL_CONTENT).count() == 1
    empty = docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(empty, quality_classifier.fit_on_labels(spark, empty, labels)).count() == 0


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in segmentations(word[k:], pieces):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    words = [b"ab", b"ba", b"aba", language_id.MARK + b"a", b"a" * 20, b"ab" * 22]
    pieces = language_id.pieces_of(words)
    p = np.random.default_rng(2).random(len(pieces.hashes))
    p_of = {w: float(p[np.searchsorted(pieces.hashes, language_id._hash_all([w])[0])]) for w in [*words, *(bytes([c]) for c in range(256))]}
    build = language_id.Lattices(pieces)
    asked = [b"abab", b"a", b"bbaab", b"a" * 23, b"ab" * 23, b"ab" * 40]

    def total(w):
        sums = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            sums[e] = sum(sums[e - len(x)] * v for x, v in p_of.items() if len(x) <= e and w[e - len(x) : e] == x)
        return np.log(sums[-1])

    short = asked[:4]
    for w, g in zip(short, language_id.log_probability(build(short), p), strict=True):
        assert abs(g - total(language_id.MARK + w)) < 1e-9
    assert abs(total(language_id.MARK + b"abab") - np.log(sum(np.prod([p_of[x] for x in s]) for s in segmentations(language_id.MARK + b"abab", p_of)))) < 1e-9
    for w in asked:
        one = build([w])
        assert abs(language_id.long_forward(one, np.log(p)[None])[0, -1] - total(language_id.MARK + w)) < 1e-9
        assert np.abs(language_id.long_expected(one, np.log(p / 9), 2.0) - language_id.expected(one, p / 9, np.array([2.0]))).max() < 1e-9


def test_identification_equals_brute_force(spark, docs):
    """Posteriors of a tiny model, a word of 90 bytes and one of 5,000 among the words."""
    pieces = language_id.pieces_of([b"ab", b"ba", language_id.MARK + b"a"])
    rng = np.random.default_rng(7)
    p = rng.random((2, len(pieces.hashes))) ** 3
    p /= p.sum(1, keepdims=True)
    model = language_id.LanguageModel(("xx", "yy"), pieces, p)
    texts = ["abba ab a", "ABAB bab", "a" * 90 + " b", "ba" * 2500, "ab\t\nba b", "éab"]
    known = {w: p[:, np.searchsorted(pieces.hashes, language_id._hash_all([w])[0])] for w in [b"ab", b"ba", language_id.MARK + b"a", *(bytes([c]) for c in range(256))]}

    def word(w):
        w, out = language_id.MARK + w, [np.zeros(2)]
        for e in range(1, len(w) + 1):
            out.append(np.logaddexp.reduce([out[e - len(x)] + np.log(known[x]) for x in {w[max(0, e - k) : e] for k in (1, 2, 4)} if x in known]))
        return out[-1]

    got = {r.doc_id: r for r in language_id.identify(docs(list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        ws = text.lower().encode().split()
        log = sum(map(word, ws)) / np.sqrt(len(ws))
        assert got[k].lang_pred == model.langs[int(log.argmax())] and abs(got[k].score - 1 / np.exp(log - log.max()).sum()) < 1e-6


@pytest.mark.parametrize("tiny", [1e-7, 1e-8, 1e-12])
def test_forward_of_rare_pieces(tiny):
    """Sums of scaled numbers and of logarithms agree for words of all lengths, and so do the counts, however small the probabilities."""
    pieces = language_id.pieces_of([b"ab"])
    p, build = np.full(len(pieces.hashes), tiny), language_id.Lattices(pieces)
    words = [bytes(200 for _ in range(n)) for n in range(1, 65)] + [b"ab" * 20 + bytes(200 for _ in range(k)) + b"ab" * 4 for k in range(0, 40, 7)]
    got = language_id.log_probability(build(words), p)
    logs = [language_id.long_forward(build([w]), np.log(p)[None])[0, -1] for w in words]
    assert np.abs(got - logs).max() < 1e-9 * np.abs(logs).max()
    mark = len(language_id.MARK)
    assert max(abs(g - (n + mark) * np.log(tiny)) for n, g in enumerate(got[:64], 1)) < 1e-6, "linear in the length"
    weight = np.arange(1.0, len(words) + 1)
    counts = sum(language_id.long_expected(build([w]), np.log(p), k) for w, k in zip(words, weight, strict=True))
    found = language_id.expected(build(words), p, weight)
    assert np.abs(found - counts).max() < 1e-6 * counts.max()


def test_language_identification(spark, docs, odd_rows):
    public = pytest.importorskip("public_tokenizers")
    rows = [(k, " ".join(random.Random(k).choices("the house river stone water bread green".split(), k=30)), "en") for k in range(40)]
    rows += [(100 + k, " ".join(random.Random(k).choices("das haus fluss stein wasser brot grün".split(), k=30)), "de") for k in range(40)]
    table = spark.createDataFrame([(i, x, g, "s", 1) for i, x, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    model = language_id.fit(spark, table, public.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows) and any(r.held_out for r in got.values())
    odd = {str(r.doc_id): r for r in language_id.identify(docs(odd_rows), model).collect()}
    assert odd["1"].lang_pred == odd["2"].lang_pred == odd["7"].lang_pred == "und" and odd["5"].lang_pred in ("en", "de")
    long = docs([(k, "x" * (70 + k) + " the water") for k in range(12)])
    assert language_id.fit(spark, long, public.path("piece_bpe_32k.model")).langs == ("en",)
    nothing = language_id.fit(spark, docs([]), public.path("piece_bpe_32k.model"))
    assert language_id.identify(docs([(1, "abc")]), nothing).first().lang_pred == "und"


def test_shingles_equal_brute_force():
    texts = ["", "a b", "a b c d e", "a b c d e a b c d e", "A b C d E f"]
    t = chunk(texts, lower=True)
    h, bounds = t.shingles(5)
    sets = [set(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    words = [x.lower().split() for x in texts]
    want = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(s) for s in want]
    assert all(len(sets[i] & sets[j]) == len(want[i] & want[j]) for i in range(5) for j in range(5))
    assert len(tc.mix(np.arange(10, dtype=np.uint64))) == 10


def test_long_texts_are_hashed_and_counted_block_by_block():
    """Words, lines and what they look like are as of the whole buffer at once, without sums of all its bytes."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from notemill.llm import quality_classifier as q
    from notemill.llm import textcore as tc

    rng = random.Random(5)
    long = "".join("".join(rng.choice("aB3#") for _ in range(rng.randrange(1, 9))) + rng.choice("  \n") for _ in range(20_000)) * 30
    long = "\n\n" + long + "é!" * (tc._KEPT // 2) + "\n" + long  # a word longer than a block
    texts = [next(tc.chunks(pa.array([long], pa.large_string()), False, 1 << 40))[2] for _ in range(2)]
    start, end, _ = texts[0].lines()
    assert (texts[0].hash == tc.SpanHasher(texts[0].buf)(texts[0].start, texts[0].end)).all()
    assert (texts[0].span_hashes(start, end) == tc.SpanHasher(texts[0].buf)(start, end)).all()
    for flags in q._CLASS.values():
        assert (tc.count_in(flags, texts[0].buf, start, end) == tc.per_span(flags[texts[0].buf], start, end)).all()
    tracemalloc.start()
    assert len(texts[1].hash) == len(texts[1].start) and tracemalloc.get_traced_memory()[0] < 3 * len(texts[1].buf)  # before: two sums of 8 bytes for each byte
    tracemalloc.stop()


def test_long_texts_take_bounded_memory_and_equal_vectors():
    """A text of millions of bytes needs no table of vectors of all its words, nor of powers of all its bytes; its hashes are as of short ones."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from notemill.llm import quality_classifier as q
    from notemill.llm import textcore as tc

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    model = q.train([(" ".join(rng.choices(words[:300] if k % 2 else words[200:], k=60)), k % 2) for k in range(60)])
    short, long = " ".join(rng.choices(words, k=400)), " ".join(rng.choices(words, k=500_000))
    both = [next(tc.chunks(pa.array([*before, long], pa.large_string()), False, 1 << 40))[2] for before in ([], [short])]
    assert (both[1].hash[400:] == both[0].hash).all() and (both[1].hash[:400] == next(tc.chunks(pa.array([short])))[2].hash).all()
    index = {w: next(tc.chunks(pa.array([w])))[2].hash[0] for w in words}
    assert (both[0].hash == np.array([index[w] for w in long.split()])).all()
    tracemalloc.start()
    one = model.score(both[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    assert 0 < one[0] < 1 and (model.pool(both[1])[1] == model.pool(both[0])[0]).all()
    v = model.vectors[model.ids(both[0].hash)].astype(float).mean(0)
    assert np.abs(model.pool(both[0])[0, : q.DIM] - v).max() < 1e-3
