import hashlib
from collections import Counter

import pytest
from conftest import SMALL
from test_jaccard import brute

import corpus_pipeline
from rookery.llm import bpe, mixing, toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, each stage on the written rows of the one before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, found[-1], SMALL).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_stay_until_the_last_stage(stages):
    assert [len(corpus_pipeline.STAGES), *({tuple(df.dtypes) for df in stages[:-1]})] == [5, tuple(stages[0].dtypes)]


def test_toxic_documents_go(spark, stages):
    scored = toxicity.score(stages[0], toxicity.fit(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet")))
    assert ids(stages[1]) == ids(scored.where("score < 0.3"))  # so few labels may tell nothing


def test_one_document_of_a_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].select("doc_id", "text").collect()]
    assert ids(stages[2]) == sorted(d for d, (_, least) in brute(rows).items() if d == least)


def test_repeated_bytes_go(stages):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in stages[2].select("doc_id", "text").collect()}
    count = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    want = {}
    for d, t in texts.items():
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        want[d] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    got = stages[3].select("doc_id", "text", "n_chars").collect()
    assert {r["doc_id"]: r["text"] or "" for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)


def test_rows_repeat_as_the_mix_takes_them(stages):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(stages[3]).where("taken > 0").collect()}
    assert Counter(ids(stages[4])) == taken


def test_rows_are_encoded(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    want = Counter((r["doc_id"], hashlib.md5(str(library.encode(r["text"] or "", add_special_tokens=False).ids).encode()).hexdigest()) for r in stages[4].select("doc_id", "text").collect())
    assert Counter((r["doc_id"], hashlib.md5(str(list(r["ids"])).encode()).hexdigest()) for r in stages[5].collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in stages[5].limit(50).collect())
