import re

import corpus_pipeline
from lectern.llm import decontaminate, pieces, toxicity

FOLDER = "/root/testdata/sf0.001"


def alike_dropped(ids, texts):
    """Of each group of texts linked by sets of five-word shingles of Jaccard similarity 0.8 or more, the least id."""
    words = {d: (texts[d] or "").encode().lower().split() for d in ids}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in words.items()}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in ids:
        for b in ids:
            if b < a and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in ids if find(d) == d]


def test_each_stage_does_its_whole_job(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.saved(stage(spark, frames[-1], FOLDER), "test"))
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert all(f.columns == columns for f in frames[:-1]) and all(len(set(i)) == len(i) for i in ids)
    labels, benchmark = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids[1] == sorted(r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect())
    first = {}
    for d in ids[1]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d] or ""), d)
    assert ids[2] == sorted(first.values())
    assert ids[3] == alike_dropped(ids[2], texts)
    leaked = {r.doc_id for r in decontaminate.leaks(frames[3], benchmark).collect()}
    assert ids[4] == [d for d in ids[3] if d not in leaked]
    assert ids[5] == ids[4]
    codec = pieces.codec(pieces.default_path())
    assert all(r.round_trip and codec.decode(r.ids) == (texts[r.doc_id] or "") for r in frames[5].collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == ids[5]
