import math
import random
import re
from collections import Counter

from rookery.llm import lexical

DOCS, ITEMS = "doc_id long, text string, item_id int, score string, number int", "item_id long, text string, rank string, terms int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    words = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = []
    for item, text in items:
        scores = []
        for d, w in words:
            m = 50 + 50 * sum(w.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w[t] // (1000 * w[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in w)
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=5):
    got = lexical.search(spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], DOCS), spark.createDataFrame([(i, t, "x", 3) for i, t in items], ITEMS), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n):
    dealt = random.Random(seed)
    words = ["É", "é", "tea", "TEA", "Tea9", "naïve", "中文", "a_b", "x" * 300, " wide ", "it's", *(f"w{i}" for i in range(40))]
    return [(i, dealt.choice([" ", "-", "\x00", "\n"]).join(dealt.choices(words, k=dealt.choice([1, 3, 9, 60])))) for i in range(n)]


def test_ranks_equal_brute_force_with_ties_nulls_and_repeats(spark):
    docs = corpus(1, 200)
    docs += [*docs[:30], (None, docs[3][1]), (None, docs[4][1]), (500, None), (501, ""), (502, " .,;!"), (503, "tea " * 60_000), *((1000 + i, "tea w1") for i in range(40))]
    items = [*corpus(2, 12), (50, None), (51, ""), (52, "..."), (53, "unknownword"), (54, "tea"), (54, "w1"), (None, "w2 w3"), (55, "tea\x7ftea TEA")]
    assert found(spark, docs, items) == brute(docs, items, 5)


def test_groups_and_tiles_of_items_change_nothing(spark, monkeypatch):
    docs, items = corpus(3, 120), corpus(4, 20)
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 7)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    assert found(spark, docs, items) == brute(docs, items, 5)


def test_terms_of_an_item_beyond_one_product(spark):
    """More terms than a product takes, and documents of many tiles."""
    docs = [(i, " ".join(f"t{j}" for j in range(i % 7, 6_000, 7 + i % 3))) for i in range(40)]
    items = [(0, " ".join(f"t{j}" for j in range(6_000))), (1, "t5")]
    assert found(spark, docs, items, 50) == brute(docs, items, 50)


def test_empty_tables(spark):
    some = [(1, "tea")]
    assert found(spark, [], some) == [] and found(spark, some, []) == [] and found(spark, [], []) == []
    assert found(spark, [(1, None)], some) == []
    # one document: the weight of its only term is above 0
    assert found(spark, some, some) == brute(some, some, 5) != []
