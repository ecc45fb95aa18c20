import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

from tokenizers import Tokenizer

from notemill.llm import chat_format, packing, token_store, tokenise, url_filter
from notemill.llm.scratch import Scratch

P = pytest.importorskip("public_tokenizers")


def ids(path, text, end):
    return np.array([*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder_is_exact(name):
    rng, e, library = random.Random(5), tokenise.encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    texts = ["".join(rng.choice("aB é's'll12²İ \n\t\xa0\x1c\u2003日Σς.,!_-") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += ["", " ", "  a", "a  ", "a\n b", "a \n\n  b", "I'll we've <|endoftext|>", "<|endoftext|>", "a<|endoftext|>\n<|ENDOFTEXT|> b", "<|startoftext|>a <|end", "x" * 200 + " " + "y" * 200]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert e(texts) == want == e(texts)
    library.encode_special_tokens = True
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokenise.Encoder(P.path(name), ordinary=True)(texts) == want


def test_unseen_words_are_encoded_together(monkeypatch):
    """Fresh words of many texts take a call to the library for each few hundred, and repeated texts none, with the ids of whole texts."""
    path = P.path("byte_bpe_50k.json")
    e, library, calls = tokenise.Encoder(path), Tokenizer.from_file(path), []
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgXYZé日²'") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", "###", "'s.", "!'s", "_9,", "-x", "—", "'", "\x00."]) for _ in range(3000)]
    texts = ["", "\n", "a ", "a\n", ".", "'s", "_", "a.b'll.c", *(rng.choice(["", " ", "\n"]) + "".join(w + rng.choice("   \n") for w in rng.sample(words, 60)) for _ in range(200))]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]

    class Counting:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(inner, name)

    inner, merge = e.tokenizer, e.merge
    monkeypatch.setattr(e, "tokenizer", Counting())
    monkeypatch.setattr(e, "merge", lambda piece: calls.append("merge") or merge(piece))
    assert e(texts) == want
    assert 2 <= calls.count("encode_batch_fast") + calls.count("merge") <= 40
    calls.clear()
    assert e(texts) == want and not calls
    monkeypatch.setattr(e.words, "most", 50)
    assert e(texts[::-1]) == want[::-1] and e(["new" + str(k) for k in range(99)]) and e(texts) == want


def test_token_store(spark, docs, odd_rows):
    path, where = P.path("byte_bpe_50k.json"), f"{Scratch(spark, 't').path}/ids"
    token_store.write_tokens(docs(odd_rows), where, path)
    got = sorted(token_store.digest(token_store.read_tokens(spark, where)).collect(), key=lambda r: r.start)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for g, (i, text) in zip(got, rows, strict=True):
        want = ids(path, text, 0)
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(want) // 4, zlib.crc32(want))
        start += g.n_tokens
    token_store.write_tokens(docs([]), where, path)
    assert token_store.digest(token_store.read_tokens(spark, where)).count() == 0


def test_selective_reads_and_files(spark, docs, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow.parquet as pq

    from notemill.llm import token_store

    path = str(tmp_path / "ids")
    token_store.write_tokens(docs([(k, f"word{k} and some more " * (1 + k % 9)) for k in range(4000)]).repartition(2), path, public.path("byte_bpe_50k.json"))
    some = token_store.read_tokens(spark, path, 1200, 1210)
    assert sorted(r.doc_id for r in some.collect()) == list(range(1200, 1211))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1200)" in plan and "LessThanOrEqual(doc_id,1210)" in plan
    meta = token_store.read_metadata(spark, path)
    assert "array" not in meta._jdf.queryExecution().executedPlan().schema().toString() and "tokens#" not in meta._jdf.queryExecution().optimizedPlan().toString().replace("n_tokens#", "").split("Relation")[0]
    assert meta.agg({"n_tokens": "sum"}).first()[0] == sum(len(r.tokens) for r in token_store.read_tokens(spark, path).collect())
    for file in (tmp_path / "ids").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
        assert any("DICTIONARY" in e for e in tokens.encodings) and group.total_byte_size <= 40 << 20
        for name in ("doc_id", "local_start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and columns[name].has_offset_index and columns[name].has_column_index


def test_packing(spark, docs, odd_rows):
    path = P.path("word_bpe_49k.json")
    rng = random.Random(2)
    rows = [*odd_rows, *((100 + k, "word " * int(rng.expovariate(1 / 400))) for k in range(300))]
    table = packing.pack(spark, docs(rows).repartition(5), path)
    pieces, texts = {}, {}
    for r in table.collect():
        pieces.setdefault(r.doc_id, []).append(r)
        texts.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    padding = total = 0
    for parts in texts.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and parts[0][2] == (at if at & (at - 1) == 0 else 4096)
        padding, total = padding + parts[0][2] - at, total + parts[0][2]
    assert padding / total < 0.05
    for i, text in rows:
        if i != 4:
            got = b"".join(bytes(r.tokens) for r in sorted(pieces[i], key=lambda r: r.start))
            assert got == ids(path, text, 2) and all(r.doc_tokens == len(got) // 4 for r in pieces[i])
    assert len(pieces[4]) == 2
    assert packing.digest(packing.pack(spark, docs([]), path)).count() == 0


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\nhi", "<\\|end|>", "<\\\\|", "", None, "a\\", "x\x00y", "<|<|||>>"]
    rows = [(k, j, role, nasty[(k + j) % len(nasty)]) for k in range(9) for j, role in enumerate(["system", "user", "assistant", "user", "assistant"][: 2 + k % 4])]
    rows += [(50, 0, "assistant", "first"), (51, 0, "we|ird>\\p\\", "x"), (51, 1, None, "y"), (None, 0, "user", "no id"), (52, 1, "assistant", "b"), (52, 0, "user", "a"), (53, 0, "user", "t"), (53, 0, "user", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_conversations(table)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(x for _, role, x in turns if role == "assistant")
        want = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[52].valid and got[52].complete and not got[50].valid and not got[53].valid
    assert chat_format.digest(chat_format.format_conversations(table.limit(0))).count() == 0
    segments = chat_format.format_conversations(table).where("conv_id = 52").first()
    assert [s.loss for s in segments.segments] == [False, False, False, False, True, False]


def test_url_filter(spark):
    urls = [
        (1, "http://a.net/x", "net/", "block"), (2, "https://www.Example.NET/en/1?q#f", "example.net/en/", "allow"), (3, "x://example.com/de/", "example.com/de/", "block"), (4, "http://b.org/fr/z", "org/fr/", "allow"),
        (5, "http://anet/x", None, None), (6, "http://example.net/en", "net/", "block"), (7, "http://a.net", None, None), (8, None, None, None), (9, "no scheme net/", None, None), (10, "", None, None),
    ]
    more = [(100 + k, f"http://site{k}.net/page/{k}", "net/", "block") for k in range(40)] + [(200 + k, f"http://site{k}.org/fr/{k}", "org/fr/", "allow") for k in range(40)]
    table = spark.createDataFrame([(i, u, 1) for i, u, _, _ in urls + more], "page_id long, url string, verdict int")
    got = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for i, u, rule, verdict in urls + more:
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict), u
    assert (got[2].host, got[2].path) == ("www.example.net", "/en/1") and (got[9].host, got[9].path) == ("", "")
    alone = spark.createDataFrame([(1, "http://x.com/")], "page_id long, url string")
    assert url_filter.judge_urls(alone).first().verdict == "allow" and url_filter.judge_urls(alone.limit(0)).count() == 0


def test_model_verdicts_equal_brute_force(spark):
    """The interpolated probability by its recursion over contexts, the ratio, the calibration and the verdict of each URL."""
    import math

    good, bad = [f"http://a{k}.org/fr/page{k % 7}" for k in range(25)], [f"http://b{k}.net/buy-{k % 5}!" for k in range(25)]
    asked = ["http://a9.com/page3", "http://x.com/buy-4!", "", None, "http://q.com/" + "z" * 3000]
    table = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    order = spark.createDataFrame([(u,) for u in good + bad], "u string").selectExpr("u", "xxhash64(u) AS h").orderBy("h", "u").collect()
    judge = url_filter.train([r.u for r in order if r.u in good], [r.u for r in order if r.u in bad])

    def brute(texts, text):
        padded = ["\x02" * 5 + x + "\x03" for x in texts]

        def p(context, c):
            below = p(context[1:], c) if context else 1 / 65536
            after = [x[i + len(context)] for x in padded for i in range(5 - len(context), len(x) - len(context)) if x.startswith(context, i)]
            return (after.count(c) + len(set(after)) * below) / (len(after) + len(set(after))) if after else below

        long = "\x02" * 5 + text + "\x03"
        return sum(math.log2(p(long[i - 5 : i], long[i])) for i in range(5, len(long)))

    for k, url in enumerate(asked):
        url = url or ""
        if len(url) < 100:
            fit = [[t for i, t in enumerate(r.u for r in order if r.u in kind) if i % 5] for kind in (good, bad)]
            ratio = (brute(fit[0], url) - brute(fit[1], url)) / (len(url) + 1)
            assert abs(ratio - judge.ratio(url)) < 1e-9
        row = got[len(good + bad) + k]
        assert row.rule is None and abs(row.probability - judge.probability(url)) < 1e-9 and row.verdict == ("allow" if row.probability >= 0.5 else "block")


def test_char_models_separate():
    judge = url_filter.train([f"good{k}" for k in range(30)], [f"spam-{k}!" for k in range(30)])
    assert judge.probability("good99") > 0.5 > judge.probability("spam-99!")


def test_new_words_of_the_word_vocabulary_are_encoded_together():
    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    e, library, calls = tokenise.Encoder(path), Tokenizer.from_file(path), []
    words = ["".join(rng.choices("abcXYZ19.,_-\u00e9\u00df", k=rng.randint(1, 12))) for _ in range(1500)]
    odd = ["it's", "'sub", "a.'s", "rock'n'roll", "\x01a", "x\x7f", "caf\u0065\u0301", "\u6f22\u5b57", "\u0416x1", "\u00b2", "a" * 60, "12345", "__init__"]
    texts = ["", " ", "\n\n", " ".join(words), "\t".join(words[:50]) + "\n", *odd, " ".join(odd), "", "A1b2"]
    want = [array("I", library.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    e.word = lambda x, word=e.word: calls.append(x) or word(x)
    assert e(texts) == want and e(texts) == want
    assert len(calls) < 20
