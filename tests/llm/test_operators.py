"""Each operator on awkward rows, against a plain version of what it must give."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P

A = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three"
DOCS = [
    (1, A), (2, None), (3, ""), (4, A), (5, A + " four five"), (5, A + " four five"), (None, "null id here"), (7, "Σίσυφος ΣΑΣ café́ x²"), (8, "  \n\t \x0b "),
    (9, "<|endoftext|>don't STOP 12½ <|startoftext|>"), (10, " ".join(f"w{i}" for i in range(30_000))), (11, "a " * 60), (12, "\x00\x1c\x85 　b"), (13, "Ünïcödé 日本語 текст"),
]
SCHEMA = "doc_id long, text string, lang string, id string, _id string, block string, bucket string, text_key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "x", None, "y", "z", "k") for i, t in DOCS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from lodestone.llm.token_counts import count_tokens

    file = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(file)
    want = Counter((i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False))) for i, t in DOCS)
    assert bag(count_tokens(docs, file), "doc_id", "n_bytes", "n_tokens") == want
    assert count_tokens(none, file).count() == 0


def test_byte_bpe(docs, none):
    import tiktoken

    from lodestone.llm.byte_bpe import decode, encode, read_ranks

    file = P.path("byte_bpe_50k.tiktoken")
    bpe = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(file), special_tokens={})
    want = Counter((i, len(ids := bpe.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t in DOCS)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in decode(encode(docs, file, P.PATTERN), file).collect())
    assert got == want
    assert encode(none, file, P.PATTERN).count() == 0


def test_substring_dedup(spark, docs, none):
    from lodestone.llm.substring_dedup import factorize

    def plain(rows):
        seen, out = {}, Counter()
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            gone = [False] * len(words)
            for k in range(len(words) - 19):
                w = tuple(words[k : k + 20])
                if w in seen:
                    gone[k : k + 20] = [True] * 20
                seen[w] = True
            out[(i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))] += 1
        return out

    def plain_factors(rows):
        """The greedy parse, word by word: each factor from its first window's earliest place on, as far as the texts agree."""
        order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in order]
        first, out = {}, Counter()
        for d, own in enumerate(words):
            for k in range(len(own) - 19):
                first.setdefault(tuple(own[k : k + 20]), (d, k))
        for d, own in enumerate(words):
            k, covered, found = 0, 0, []
            while k < len(own) - 19:
                e, x = first[tuple(own[k : k + 20])]
                if (e, x) == (d, k):
                    k += 1
                    continue
                n = 20
                while k + n < len(own) and x + n < len(words[e]) and own[k + n] == words[e][x + n]:
                    n += 1
                start = max(k, covered)
                found.append((start, k + n - start, order[e][0], x + start - k))
                covered, k = k + n, k + n - 19
            out[(order[d][0], tuple(found))] += 1
        return out

    def factors(df):
        return Counter((r.doc_id, tuple(map(tuple, r.factors))) for r in df.collect())

    columns = ("doc_id", "n_words", "n_removed", "kept")
    assert bag(factorize(docs, block_chars=400), *columns) == plain(DOCS)
    assert bag(factorize(docs), *columns) == plain(DOCS)
    assert factorize(none).count() == 0
    rng = np.random.default_rng(1)
    rows = [(int(i), " ".join(map(str, rng.integers(0, 3, rng.integers(0, 90))))) for i in rng.permutation(150)]
    rows += [(200 + i, " ".join(["p q r"] * (i % 30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert bag(factorize(df, block_chars=1500), *columns) == plain(rows)
    assert factors(factorize(df, block_chars=1500)) == factors(factorize(df)) == plain_factors(rows)
    middle, whole = " ".join(f"m{i}" for i in range(30)), [f"w{i}" for i in range(100)]
    whole[40:70] = middle.split()
    rows = [(0, "x " * 5 + middle), (1, " ".join(whole)), (2, " ".join(whole)), (3, " ".join(whole[:60] + whole[50:])), (-1, middle + " y"), (None, " ".join(whole[10:90]))]
    for size in (10, 400, 10_000):
        got = factors(factorize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_chars=size))
        assert got == plain_factors(rows) and got[(2, ((0, 100, 1, 0),))] == 1


def test_decontamination(spark, docs, none, monkeypatch):
    from lodestone.llm import decontamination as D

    items = [(0, " ".join(A.split()[3:22]).upper()), (1, "two, three"), (1, "two, three"), (2, None), (3, ""), (None, "null, id"), (4, " ".join(A.split()[:12] + ["no"]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = Counter()
    for i, t in DOCS:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            for k in range(max(1, len(x) - 12) if x else 0):
                win = x[k : k + 13]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found |= {item} - {None}
        want[(i, len(w), len(hit), tuple(sorted(found)))] += 1
    got = lambda df: Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in df.collect())
    assert got(D.contamination(docs, bench)) == want
    monkeypatch.setattr(D, "SHARD_CHARS", 300)  # several shards
    assert got(D.contamination(docs, bench.repartition(4).withColumn("shard", F.lit("clash")))) == want
    assert D.contamination(none, bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    index = D.build_index(docs)
    assert bag(D.matches(index, ["beta gamma", "", "zzz"]).where("doc_id = 1"), "phrase", "start", "n_words") == {(0, 1, 2): 1}
    assert bag(D.matches(index, ["delta beta"], span=3).where("doc_id = 4"), "start", "n_words") == {(1, 3): 1}
    assert D.matches(index, ["delta beta"], span=2).count() == 0


def test_components_of_chains(spark):
    from lodestone.llm.near_dedup import components

    links = [(bytes([i]), bytes([i + 1])) for i in range(40) if i != 20] + [(b"z", b"z")]
    got = {(bytes(r.node), bytes(r.root)) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {(bytes([i]), bytes([0 if i <= 20 else 21])) for i in range(41)}


def test_fingerprints(spark, docs, none):
    from lodestone.llm import fingerprints as M

    out = M.with_next(docs).select("doc_id", "text", "next_text", M.edited(F.col("text"), F.col("next_text")).alias("e"), M.root(M.tree(F.col("text"))).alias("r"))
    order = sorted(((i, t or "") for i, t in DOCS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        want[(i, t, nxt, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])] += 1
    assert bag(out, "doc_id", "text", "next_text", "e") == want
    by_text = {}
    for r in out.collect():
        assert by_text.setdefault(r.text, r.r) == r.r
    assert len(set(by_text.values())) == len(by_text)
    assert M.with_next(none).count() == 0
    one = spark.createDataFrame([("a. b\nc\n\nd", "a. b\nX\n\nd")], "x string, y string")
    assert [tuple(d) for d in one.select(M.differing(M.tree(F.col("x")), M.tree(F.col("y"))).alias("d")).first().d] == [(0, 1)]
    assert one.select(M.likeness(M.leaf_set(M.tree(F.col("x"))), M.leaf_set(M.tree(F.col("y")))).alias("s")).first().s == pytest.approx(6 / 8)


def test_chat_format(spark):
    import json

    from lodestone.llm import chat_format as T

    said = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 5, "a:b#<", "\n\\\\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_text) for r in T.read_back(T.format_rows(df)).collect()}
    assert got == {1: ([("user", said), ("assistant", said)], said), 2: ([("", ""), ("user", "x"), ("user", "x")], ""), None: ([("a:b#<", "\n\\\\n")], "")}
    assert T.read_back(T.format_rows(df.limit(0))).count() == 0
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"prompt": "p", "completion": "c"}, {"instruction": "i", "input": "n", "output": "o"}, {"conversations": [{"from": "human", "value": "v"}]}, {"what": 1}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("no json",)], "record string")
    got = [None if r.turns is None else [tuple(t) for t in r.turns] for r in T.canonical(df).collect()]
    assert got == [[("user", "a"), ("assistant", "b")], [("user", "p"), ("assistant", "c")], [("user", "i\n\nn"), ("assistant", "o")], [("user", "v")], None, None, None]


def test_viterbi_is_exact():
    from lodestone.llm.language_id import label_words

    rng = np.random.default_rng(5)
    lens = np.array([0, 1, 31, 32, 33, 200, 7, 0])
    scores = rng.normal(0, 4, (int(lens.sum()), 3)).astype(np.float32)
    got, at = label_words(scores, lens, 5.0), 0
    value = lambda s, way: float(sum(s[i, w] for i, w in enumerate(way)) - 5.0 * sum(a != b for a, b in zip(way[1:], way[:-1], strict=True)))
    for n in lens:
        s, best = scores[at : at + n], np.zeros(3)
        for k in range(n):
            best = (np.maximum(best, best.max() - 5.0) if k else best) + s[k]
        if n:
            assert value(s, got[at : at + n].tolist()) == pytest.approx(best.max(), abs=1e-3)
        at += n


def test_language_id(spark, docs, none):
    from lodestone.llm.language_id import fit, identify

    text = {"en": "the house of the man and the dog with that thing", "fr": "le chien de la maison est dans les rues avec une", "ru": "собака в доме и человек на улице с вещами"}
    rows = [(k * 10 + i, " ".join(np.random.default_rng(k * 10 + i).permutation(t.split() * 4)), lang) for k, (lang, t) in enumerate(text.items()) for i in range(8)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, "the dog and the man", "en"), (2, "собака", "ru"), (3, None, "und"), (4, "12 !?", "und"), (5, "le chien de la maison " * 9 + "the man of the house with that thing " * 3, "fr")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame([(i, t) for i, t, _ in tests], "doc_id long, text string"), model).collect()}
    assert {i: got[i].lang_pred for i in got} == {i: lang for i, _, lang in tests}
    assert [s.lang for s in got[5].spans] == ["fr", "en"] and 0 < got[5].score < 1
    assert identify(docs, model).count() == len(DOCS) and identify(none, model).count() == 0
    assert {r.lang_pred for r in identify(docs, fit(none)).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    from lodestone.llm.toxicity import fit, score

    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ka", "lo", "mi"], 40), rng.choice(["nu", "po", "ri"], 40), strict=True)]
        if i % 5 == 0:
            words[7] = "badword" + str(rng.choice(["s", "y", ""]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    model = fit(spark.createDataFrame(rows[:200], "doc_id long, text string, toxic int"))
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows[200:], "doc_id long, text string, toxic int"), model).collect()}
    assert all((got[i] >= 0.3) == bool(toxic) for i, _, toxic in rows[200:])
    assert score(docs, model).count() == len(DOCS) and score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in score(docs, fit(docs.withColumn("toxic", F.lit(0)))).collect())
