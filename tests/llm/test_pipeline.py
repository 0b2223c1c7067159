from corpus_rows import prose

import corpus_pipeline
from scanweave.llm import mixing
from scanweave.llm.common import stored


def sentence(seed):
    return ". ".join(prose(seed * 31 + k, 9).capitalize() for k in range(9)) + "."


def test_stages_by_hand(spark, docs_of):
    good = [(i, sentence(i), "ab"[i % 2]) for i in range(150)]
    copies = [(1000 + i, sentence(i), "a") for i in range(10)]
    near = [(2000 + i, sentence(20 + i) + " more", "b") for i in range(10)]
    bad = [(3000 + i, " ".join(w + "###" for w in prose(i, 90).split()), "a") for i in range(20)]
    docs = docs_of(good + copies + near + bad)
    left = [{d for d, *_ in good + copies + near}]
    left.append(left[0] - set(range(10)))
    left.append(left[1] - {2000 + i for i in range(10)})
    for (name, stage), want in zip(corpus_pipeline.STAGES, left, strict=False):
        docs = stored(stage(spark, docs, ""), name)
        assert {r["doc_id"] for r in docs.collect()} == want and docs.count() == len(want), name
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, docs, ""), "mix")
    assert mixed.count() == sum(times.values()) and mixed.columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, mixed, "").count() == mixed.count()


def test_stages_take_odd_and_empty_tables(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, ""), name)
            if name != "tokens":
                assert out.columns == docs.columns
