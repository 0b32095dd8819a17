"""Short documents at the threshold: no pair is left to chance."""

import numpy as np

from lodestone.llm import near_dedup as N


def test_similar_sets_of_few_words_always_meet():
    rng = np.random.default_rng(4)
    tried = 0
    for n in range(1, 31):
        for m in range(n, 31):
            for shared in range(n + 1):
                if shared / (n + m - shared) < N.SIMILAR or n > N.FEW:
                    continue
                for _ in range(20):
                    tried += 1
                    pool = rng.integers(1, 1 << 63, n + m).tolist()
                    a, b = rng.permutation(pool[:n]).tolist(), rng.permutation(pool[n - shared : n - shared + m]).tolist()
                    mine, other = (N.all_sketches_of(np.array(x, np.uint64), N.items_of(x), N.seeds()) for x in (a, b))
                    assert np.intersect1d(mine, other).size
    assert tried > 1000


def test_short_pairs_at_the_threshold(spark):
    rows = []
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:4] + [f"o{k}"] + words[5:]))]  # 8 of 10
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
