"""The classifiers against plain versions: no hashing, no blocks, no slices, one text after the other."""

import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id as L
from lodestone.llm import toxicity as T


def words_of(text):
    """A letter and the letters and marks that follow it, of the lower-case text."""
    out, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def grams_of(word, orders):
    whole = f"<{word}>"
    return [whole[i : i + n] for n in orders for i in range(len(whole) - n + 1)]


def script_of(word):
    name = lambda c: [s for at, s in L.SCRIPTS if at <= ord(c)][-1]
    counts = Counter(map(name, word))
    return min(counts, key=lambda s: (-counts[s], L.NAMES.index(s)))


def plain_model(rows):
    counts, letters = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for word in words_of(text):
            counts[lang].update(grams_of(word, L.ORDERS))
            letters[lang][script_of(word)] += len(word)
    return counts, letters


def plain_identify(text, model):
    counts, letters = model
    langs = sorted(counts)
    total = {k: sum(counts[k].values()) + 0.5 * (1 << L.BITS) for k in langs}
    words = words_of(text)
    rows = []
    for word in words:
        fits = [k for k in langs if letters[k][script_of(word)] >= L.SCRIPT_SHARE * sum(letters[k].values()) and letters[k][script_of(word)]]
        value = {k: sum(math.log((counts[k][g] + 0.5) / total[k]) + L.BITS * math.log(2) for g in grams_of(word, L.ORDERS)) / len(L.ORDERS) for k in fits}
        rows.append({k: value.get(k, min(value.values()) - L.OUTSIDE) for k in langs} if fits else None)
    best, came = dict.fromkeys(langs, 0.0), []
    for k, row in enumerate(rows):
        top = max(langs, key=lambda x: (best[x], -langs.index(x)))
        came.append({x: x if best[x] >= best[top] - L.SWITCH or not k else top for x in langs})
        best = {x: (best[x] if not k else max(best[x], best[top] - L.SWITCH)) + (row[x] if row else 0) for x in langs}
    state, labels = max(langs, key=lambda x: (best[x], -langs.index(x))), []
    for step in reversed(came):
        labels.append(state)
        state = step[state]
    labels = [x if row else "und" for x, row in zip(reversed(labels), rows, strict=True)]
    votes = Counter()
    for word, label in zip(words, labels, strict=True):
        votes[label] += len(word)
    every = sum(votes.values())
    del votes["und"]
    if not votes:
        return "und", 0.0, 0.0
    lang = min(votes, key=lambda x: (-votes[x], x))
    usual = sum(n * (math.log((n + 0.5) / total[lang]) + L.BITS * math.log(2)) for n in counts[lang].values()) / len(L.ORDERS) / sum(letters[lang].values())
    gain = sum(row[lang] for row, label in zip(rows, labels, strict=True) if label == lang) / every / usual
    return lang, votes[lang] / every, gain


TEXT = {"de": "der hund und das haus mit dem mann sind auf einem feld gewesen", "en": "the house of the man and the dog with that thing is on a field", "fr": "le chien de la maison est dans les rues avec une chose", "ru": "собака в доме и человек на улице с вещами"}


def test_identify_equals_a_plain_version(spark):
    rng = np.random.default_rng(8)
    taught = [(k * 100 + i, " ".join(rng.permutation(t.split() * 4)), lang) for k, (lang, t) in enumerate(TEXT.items()) for i in range(8)]
    taught += [(None, "des maisons", None), (900, None, "fr")]
    odd = ["\u0301 12", "e\u0301te\u0301 \u0301x", None, "", "12", "日本語 the man", "日本語", "der собака", "the" * 3000, " ".join(TEXT.values()), "собакаthe", "ΑΒΓ the man of"]
    texts = odd + odd[:3] + [" ".join(rng.choice(TEXT[a].split(), rng.integers(1, 60)).tolist() + rng.choice(TEXT[b].split(), rng.integers(0, 60)).tolist()) for a in TEXT for b in TEXT for _ in range(6)]
    model = plain_model([(t, lang) for _, t, lang in taught if t and lang])
    want = Counter((i, *((p := plain_identify(t, model))[:1]), round(p[1], 9)) for i, t in enumerate(texts))
    shape = "doc_id long, text string, lang string, lang_pred string, score string"
    fitted = L.fit(spark.createDataFrame(taught, "doc_id long, text string, lang string").withColumn("id", F.lit("clash")))
    docs = spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in enumerate(texts)], shape).repartition(3)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(docs, fitted).collect())
    assert got == want
    assert {r.lang_pred for r in L.identify(docs.where("text = '\u0301 12'"), fitted).collect()} == {"und"}


def test_very_long_words_and_texts_without_spaces(spark):
    fitted = L.fit(spark.createDataFrame([(1, TEXT["en"], "en"), (2, "日本語の文章です", "ja")], "doc_id long, text string, lang string"))
    rows = [(1, "日本語" * 400_000), (2, "the man " * 200_000), (3, "x" * 1_000_000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string"), fitted, with_spans=False).collect()}
    assert got == {1: ("ja", 1.0), 2: ("en", 1.0), 3: ("en", 1.0)}


@pytest.mark.parametrize("n_langs", [3, 40])
def test_viterbi_with_few_and_many_languages(n_langs):
    rng = np.random.default_rng(n_langs)
    lens = np.array([0, 1, 39, 40, 41, 130])
    scores = rng.normal(0, 4, (int(lens.sum()), n_langs)).astype(np.float32)
    got, at = L.label_words(scores, lens, 5.0), 0
    for n in lens.tolist():
        s, best, way = scores[at : at + n], None, got[at : at + n].tolist()
        for row in s:
            best = row.astype(float) if best is None else np.maximum(best, best.max() - 5.0) + row
        if n:
            value = sum(float(s[i, w]) for i, w in enumerate(way)) - 5.0 * sum(a != b for a, b in zip(way[1:], way[:-1], strict=True))
            assert value == pytest.approx(best.max(), abs=1e-3)
        at += n


def plain_toxicity(rows, asked):
    """Naive Bayes log-count ratios times counts of distinct words' n-grams; logistic regression by plain gradient descent."""
    count = lambda text: Counter(g for w in dict.fromkeys(words_of(text)) for g in grams_of(w, T.ORDERS))
    docs = [(count(text), toxic) for text, toxic in rows]
    sums = [Counter(), Counter()]
    for own, toxic in docs:
        sums[toxic].update(own)
    names = {g: k for k, g in enumerate(sorted(sums[0] | sums[1]))}
    smooth = [np.array([s[g] + 1.0 for g in names]) for s in sums]
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    matrix = lambda some: np.array([[c.get(g, 0) for g in names] for c in some], float) * ratio
    x, y = matrix([c for c, _ in docs]), np.array([t for _, t in docs], float)
    w, b = np.zeros(len(names)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(400):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        w -= 0.02 * (x.T @ error + 1e-5 * w)
        b -= 0.02 * error.sum()
    return 1 / (1 + np.exp(-(matrix([count(t) for t in asked]) @ w + b)))


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["ka", "lo", "mi", "te"], 30), rng.choice(["nu", "po", "ri"], 30), strict=True)]
        if i % 4 == 0:
            words[int(rng.integers(30))] = str(rng.choice(["badwords", "badwordy", "vilest"]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_agrees_with_a_plain_version(spark):
    rows = made_up(400, 6)
    shape = "doc_id long, text string, toxic int"
    taught, asked = rows[:250], rows[250:]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in taught], "doc_id long, text string, label string, toxic int")
    labels = spark.createDataFrame([(i, y, "clash") for i, _, y in taught] + [(None, 1, "x"), (3, None, "x"), (taught[0][0], taught[0][2], "x")], "doc_id long, toxic int, text string")
    model = T.fit(T.labelled(docs, labels))
    got = {r.doc_id: r.score for r in T.score(spark.createDataFrame(asked, shape), model).collect()}
    want = plain_toxicity([(t, y) for _, t, y in taught], [t for _, t, _ in asked])
    assert [got[i] >= 0.3 for i, _, _ in asked] == (want >= 0.3).tolist() == [bool(y) for _, _, y in asked]


def test_the_labelled_sample_is_bounded(spark):
    rows = made_up(900, 7)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, rows[1][1])] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 0)] * 500, "doc_id long, toxic int")
    got = T.labelled(docs, labels, sample=200).distinct()
    assert 80 <= got.count() <= 300
    assert T.labelled(docs.limit(0), labels).count() == 0 and T.labelled(docs, labels.limit(0)).count() == 0
    some = T.fit(T.labelled(docs, labels, sample=200), sample=200)
    assert {r.score for r in T.score(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), some).collect()} == {1 / (1 + math.exp(-some.intercept))}
    assert T.score(spark.createDataFrame([(1, "badwords " * 300_000)], "doc_id long, text string"), some).first().score > 0.5
