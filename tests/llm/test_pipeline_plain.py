"""The whole pipeline against plain Python, stage by stage and row by row, on a small corpus with planted cases."""

from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from lodestone.llm.byte_bpe import read_ranks
from lodestone.llm.common import plain_words
from tests.llm.test_classifiers import plain_identify, plain_model
from tests.llm.test_near_edit import similar

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka lo mi nu pe ra si", "bb": "sch ein ung ver ich ten auf", "cc": "до ма ко не ре ла ты"}


def corpus():
    rng = np.random.default_rng(12)
    vocabulary = {lang: ["".join(rng.choice(parts.split(), rng.integers(2, 4))) for _ in range(400)] for lang, parts in SYLLABLES.items()}
    say = lambda lang, n: rng.choice(vocabulary[lang], n).tolist()
    docs, bench = [], [say("aa", 30), say("bb", 14), say("cc", 6)]
    for k in range(45):
        lang = sorted(SYLLABLES)[k % 3]
        words = say(lang, int(rng.integers(30, 150)))
        docs.append((k, words, lang if k % 7 else None))
        if k % 4 == 0:  # near copies, with a later and with no id
            for i in (100 + k, None):
                copy = list(words)
                for at in rng.integers(0, len(words), len(words) // 25):
                    copy[at] = str(rng.choice(vocabulary[lang]))
                docs.append((i, copy, lang))
    passage = say("aa", 25)
    for k in (3, 9, 15, 21):
        docs[k] = (docs[k][0], docs[k][1][:20] + passage + docs[k][1][20:], docs[k][2])
    docs += [(201, say("aa", 10) + bench[0][5:25] + say("aa", 100), "aa"), (202, say("bb", 40) + bench[1] + say("bb", 10), "bb"), (203, say("cc", 300) + bench[2], "cc"), (None, say("cc", 20) + bench[2], "cc")]
    rows = [(i, " ".join(w), lang, f"s{n % 3}", 1) for n, (i, w, lang) in enumerate(docs)]
    rows += [rows[2], rows[5], (5, rows[6][1] + " " + " ".join(say("aa", 60)), "aa", "s", None), (301, None, "aa", "s", 0), (302, "", "aa", "s", 0), (303, "12 !!", None, None, 5), (304, "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι", None, "s", 1), (None, "xqzvk wjpfq bzxkvw qqjxz vkwpz xjqfw", None, "s", 1)]
    rows += [(400, rows[0][1] + "  \n", "aa", "s", 1), (401, " ".join(say("aa", 40)) + " " + " ".join(say("bb", 41)), None, "s", 1), (402, " ".join(passage), "aa", "s", 1)]
    return rows, [(k, " ".join(w)) for k, w in enumerate(bench)]


def plain_language(rows):
    model = plain_model([(t, lang) for _, t, lang, _, _ in rows if t is not None and lang is not None])
    told = [(r, plain_identify(r[1], model)) for r in rows]
    return [(r[0], r[1], lang, r[3], r[4]) for r, (lang, score, gain) in told if lang != "und" and score >= corpus_pipeline.LEAST_SHARE and gain >= corpus_pipeline.LEAST_GAIN]


def plain_near(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or similar(rows[i][1], rows[j][1]):
                root[find(i)] = find(j)
    classes = {}
    for i, row in enumerate(rows):
        classes.setdefault(find(i), []).append(row)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def plain_substrings(rows):
    seen, out = set(), []
    for i, text, *rest in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = text.split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        if any(gone):
            text = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, text, *rest[:2], len(text)))
    return out


def plain_clean(rows, bench):
    out = []
    for row in rows:
        words, hit = plain_words(row[1]), set()
        for _, item in bench:
            own = plain_words(item)
            for k in range(max(1, len(own) - 12)):
                window = own[k : k + 13]
                for at in range(len(words) - len(window) + 1):
                    if words[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
        if not hit or 20 * len(hit) < len(words):
            out.append(row)
    return out


@pytest.fixture
def paths(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SHAPE + ", _own string, text_key string, id string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, bench, str(tmp_path)


def test_the_pipeline_equals_a_plain_version(spark, paths):
    rows, bench, sf_dir = paths
    counts = [len(rows)]
    for stage in (plain_language, plain_near, plain_substrings, lambda r: plain_clean(r, bench)):
        rows = stage(rows)
        counts.append(len(rows))
    assert all(a > b for a, b in zip(counts[:2], counts[1:3], strict=True)) and counts[2] == counts[3] > counts[4] > 40
    bpe = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((i, tuple(bpe.encode_ordinary(text))) for i, text, *_ in rows)
    got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_each_stage_equals_its_plain_version(spark, paths):
    rows, bench, sf_dir = paths
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (plain_language, plain_near, plain_substrings, lambda r: plain_clean(r, bench)), strict=False):
        got = [tuple(r) for r in stage(spark, spark.createDataFrame(rows, SHAPE).repartition(3), sf_dir).collect()]
        rows = plain(rows)
        assert Counter(got) == Counter(rows), stage.__name__
