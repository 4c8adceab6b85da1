import hashlib
import random

from rookery.llm import suffixes

SCHEMA = "doc_id long, text string, bucket int, kind int, digest string"


def brute(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, t in texts:
        for i in range(len(t) - 199):
            count[t[i : i + 200]] = count.get(t[i : i + 200], 0) + 1
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def cases(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdeé 日\n") for _ in range(n))
    passages = [some(700), some(260), some(150)]
    rows = []
    for d in range(50):
        text = some(r.randrange(300))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            i = r.randrange(len(p))
            text += p[i : i + r.randrange(400)] + some(r.randrange(60))
        rows.append((d, text))
    base = some(1500)
    for d in range(60, 90):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = "X"
        rows.append((d, "".join(t)))
    rows += [(200, None), (201, ""), (202, "a" * 199), (203, "a" * 900), (204, "ab" * 300), (205, base), (206, base), (207, "x" * 200), (208, "x" * 200), (209, some(150)), (None, base[:400]), (60, "short")]
    r.shuffle(rows)
    return rows


def check(spark, rows, **bounds):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], SCHEMA).repartition(5)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove(df, **bounds).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_against_brute_force(spark):
    check(spark, cases(1))


def test_hot_groups(spark):
    check(spark, cases(2), hot=6)


def test_loser_tree_and_front_coding():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(30))) for _ in range(7)]
    coded = [suffixes.decoded(suffixes.front_coded([(s, b"l", 0) for s in run])) for run in runs]
    assert [c[1] for c in coded] == runs
    out = list(suffixes.merged([c[:2] for c in coded]))
    merged = [runs[i][j] for i, j, _ in out]
    assert merged == sorted(x for run in runs for x in run)
    assert [n for _, _, n in out][1:] == [suffixes.common(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_empty(spark):
    assert suffixes.remove(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_hashes_of_different_strings_are_told_apart(monkeypatch):
    r = random.Random(6)
    base = bytes(r.choice(b"abc") for _ in range(300))
    some = [base, base[:250] + b"d" + base[251:], base[:180] + b"e" + base[181:], bytes(r.choice(b"xyz") for _ in range(300))] * 5
    held = sorted((t[60:260], t[r.randrange(30) : 60][::-1]) for t in some)
    prefixes = [0, *(suffixes.common(a[0], b[0]) for a, b in zip(held, held[1:], strict=False))]
    expected = suffixes.distinct_masks([s for s, _ in held], [b for _, b in held], prefixes)
    monkeypatch.setattr(suffixes, "mixed", lambda x: x * 0)
    assert suffixes.distinct_masks([s for s, _ in held], [b for _, b in held], prefixes) == expected != [0] * 20


def test_buckets_hold_no_more_as_texts_grow(spark):
    from rookery.llm import _batches

    few, many = (_batches.buckets_of(spark, n * 64 * _batches.BUCKET_BYTES) for n in (4, 16))
    assert many == 4 * few and _batches.buckets_of(spark, 0) >= 64
