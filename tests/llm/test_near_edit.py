"""Near-duplicates against plain versions: all pairs, each by the full table of its longest common subsequence."""

import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import near_dedup as N


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def similar(a, b):
    a, b = words_of(a), words_of(b)
    both = sum((Counter(a) & Counter(b)).values())
    if not a or not b or 10 * both < 8 * (len(a) + len(b) - both):
        return False
    c = common(a, b)
    return 10 * c >= 8 * (len(a) + len(b) - c)


def classes(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and ((rows[i][1] or "") == (rows[j][1] or "") or similar(rows[i][1], rows[j][1])):
                root[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)] = min(names.get(find(i), doc), doc)
    return Counter((doc, names.get(find(i))) for i, (doc, _) in enumerate(rows))


def edit(words, share, rng, tag):
    out = []
    for k, w in enumerate(words):
        if rng.random() >= share:
            out.append(w)
        elif (how := rng.integers(3)) == 0:
            out.append(f"{tag}s{k}")
        elif how == 1:
            out += [w, f"{tag}i{k}"]
    return out


def got(df):
    return Counter((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect())


SHAPE = "doc_id long, text string, bucket string, root string, text_key string, a string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", "v") for i, t in rows], SHAPE).repartition(3)


def test_classes_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    boiler = [f"licence{i}" for i in range(60)]
    rows = []
    for g in range(14):
        base = [f"g{g}w{i}" for i in rng.integers(0, 400, rng.integers(3, 160))]
        for c in range(int(rng.integers(1, 6))):
            rows.append((len(rows), " ".join(edit(base, 0.05, rng, f"g{g}c{c}") + boiler * (g % 3 == 0))))
    rows += [(900, None), (901, ""), (902, "short text"), (903, "short text"), (904, "Short, text"), (None, rows[0][1]), (3, rows[3][1]), (905, " ".join(["again"] * 300)), (906, " ".join(["again"] * 250)), (907, " ".join(["again"] * 239))]
    rows += [(None, "no id one two three"), (None, "no id one two three"), (908, "!!")]
    assert got(frame(spark, rows)) == classes(rows)
    assert N.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.zipf(1.3, 300_000) % 50_000]
    rows = [(1, " ".join(base)), (2, " ".join(edit(base, 0.04, rng, "e"))), (3, " ".join(rng.permutation(base))), (4, "x" * 3_000_000)]
    assert got(frame(spark, rows)) == Counter({(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 4): 1})


@pytest.mark.parametrize("long", [N.LONG, 0])
def test_alignment_equals_the_full_table(long, monkeypatch):
    monkeypatch.setattr(N, "LONG", long)
    rng = np.random.default_rng(int(long))
    for _ in range(300):
        a = [str(x) for x in rng.integers(0, 30 if long else 10**6, rng.integers(1, 90))]
        b = edit(a, rng.choice([0.02, 0.08, 0.15]), rng, "e")
        c, value = common(a, b), N.similarity(*(N.Text(" ".join(x)) for x in (a, b)))
        want = c / (len(a) + len(b) - c) if b else 0.0
        assert value == pytest.approx(want) if want >= N.SIMILAR else value < N.SIMILAR


@pytest.mark.parametrize("share", [0.03, 0.05, 0.08])
def test_recall_of_edited_copies(spark, share):
    """Of seeded pairs that are similar, those that end in one class."""
    rng = np.random.default_rng(int(share * 100))
    rows = []
    for k in range(150):
        base = [f"k{k}w{i}" for i in rng.integers(0, 5000, rng.integers(25, 500))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edit(base, share, rng, f"k{k}")))]
    alike = [k for k in range(150) if similar(rows[2 * k][1], rows[2 * k + 1][1])]
    found = dict(got(frame(spark, rows)).keys())
    assert len(alike) > 100 and sum(found[2 * k + 1] == 2 * k for k in alike) >= 0.95 * len(alike)
    assert all(found[i] // 2 == i // 2 for i in found)
