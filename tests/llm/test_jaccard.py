import random
import re

from rookery.llm import jaccard

SCHEMA = "doc_id long, text string, key long, n int, kind string"


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def cases(seed, groups=12, of=14, long=90):
    r = random.Random(seed)
    word = lambda: "w" + str(r.randrange(3000))
    rows, d = [], 0
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(8, long))]
        for _ in range(of):
            t = list(base)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append((d := d + r.randrange(1, 4), " ".join(t)))
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "one two"), (5004, "One\ttwo"), (5005, "two one"), (5006, "a b c d e"), (5007, "a b c d e "), (5008, "x " * 400), (5009, "x " * 900)]
    r.shuffle(rows)
    return rows


def check(spark, rows, **bounds):
    df = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, **bounds).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark):
    check(spark, cases(1))


def test_frequent_tokens_and_blocks(spark):
    check(spark, cases(2, groups=4, of=45, long=60), frequent=1, block=10)
    check(spark, cases(3, groups=2, of=60, long=30), frequent=0, block=1000)


def test_empty_and_null_ids(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = jaccard.join(spark.createDataFrame([(None, "a b c d e f", 1, 2, "k"), (3, "a b c d e f", 1, 2, "k"), (3, "a b c d e f", 1, 2, "k")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (3, 3), (3, 3)]


def test_a_hub_with_many_sets_that_do_not_link(spark):
    """Texts of one template with slots: frequent tokens in all, links in some, in rings around the hub and of several sizes."""
    r = random.Random(8)
    line = [f"t{i}" for i in range(60)]
    rows = []
    for d in range(150):
        own = list(line[: r.choice([40, 50, 60])])
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            own[r.randrange(len(own))] = f"own{r.randrange(40)}"
        rows.append((d, " ".join(own)))
    check(spark, rows, frequent=1, block=8)
    check(spark, rows, frequent=0, block=20)


def test_words_that_polynomials_take_for_equal(spark):
    rows = []
    for i, n in enumerate((512, 1_024, 4_096)):
        turn = [bin(j).count("1") % 2 for j in range(n)]
        for k, letters in enumerate(("ab", "ba")):
            word = "".join(letters[t] for t in turn)
            rows += [(100 * i + k, f"{word} b{i} c d"), (100 * i + 10 + k, " ".join(f"{word} {i}{j}" for j in range(20)))]
    check(spark, rows)
