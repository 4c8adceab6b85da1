import hashlib
import random
import re

from rookery.llm import substring

SCHEMA = "doc_id long, text string, source string, bucket int, batch long, words string"


def brute(rows):
    seen, out = {}, {}
    ordered = sorted(rows, key=lambda r: r[0])
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in ordered}
    for d, _ in ordered:
        for i in range(len(words[d]) - 19):
            seen.setdefault(tuple(words[d][i : i + 20]), (d, i))
    for d, _ in ordered:
        w = words[d]
        gone = set()
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] != (d, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def cases():
    r = random.Random(5)
    word = lambda: r.choice(["a", "bb", "ç", "日本", "x,"]) + str(r.randrange(30))
    shared = [word() for _ in range(70)]
    rows = [(d, " ".join([*(word() for _ in range(r.randrange(40))), *shared[r.randrange(30) : r.randrange(30, 70)], *(word() for _ in range(r.randrange(40)))])) for d in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two"), (104, "la " * 500), (105, "la " * 20), (106, rows[3][1]), (107, rows[3][1].replace(" ", "\n\n"))]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame([(d, t, "s", 1, 2, "w") for d, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove(df).collect()}
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert substring.remove(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring.remove(spark.createDataFrame([(None, text, "s", 1, 2, "w"), (7, text, "s", 1, 2, "w"), (7, text, None, 1, 2, "w")], SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in rows) == [(False, 0), (False, 0), (True, 30)]


def twins(n):
    """Two words of n bytes that are the same under a polynomial modulo 2^64 with any odd base."""
    turn = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)


def test_words_that_polynomials_take_for_equal(spark):
    rows = []
    for i, n in enumerate((512, 1_024, 4_096)):
        one, other = twins(n)
        rest = [f"x{i}y{j}" for j in range(30)]
        rows += [(10 * i, " ".join([*rest[:7], one, *rest[7:]])), (10 * i + 1, " ".join([*rest[:7], other, *rest[7:]]))]
    # windows of two words in that order
    turns = "".join("ab"[bin(i).count("1") % 2] for i in range(64))
    rows += [(50, " ".join(turns)), (51, " ".join(turns.translate(str.maketrans("ab", "ba"))))]
    df = spark.createDataFrame([(d, t, "s", 1, 2, "w") for d, t in rows], SCHEMA)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove(df).collect()} == brute(rows)


def test_hashes_depend_on_all_bytes_and_their_places():
    import numpy as np

    from rookery.llm import _words

    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 17, "aaaaaaaabbbbbbbb", "bbbbbbbbaaaaaaaa", *twins(1_024), *twins(4_096)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    begin, end, _ = _words.spans(data, np.array([0, len(data)]))
    first, second = (_words.hashes(data, begin, end, seed) for seed in (0, 1))
    assert len({*first.tolist(), *second.tolist()}) == 2 * len(words)
    for k in range(1, 23):
        held = _words.windows(np.tile(first, 4), k)
        assert len(held) == 4 * len(words) - k + 1 and (held[: len(words)] == held[len(words) : 2 * len(words)]).all() and len(set(held.tolist())) == len(words)
