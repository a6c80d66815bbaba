"""The pipeline's stages over a small table, each against what a plain loop does with the stage's own input."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from millrace.llm import quality_classifier, queries

from .test_operators import changed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(i)))
        tables.append(spark.read.parquet(str(tmp_path / str(i))))
        assert i == len(corpus_pipeline.STAGES) - 1 or tables[-1].columns == docs.columns
    got = [[r.asDict() for r in t.collect()] for t in tables]
    ids = [[r["doc_id"] for r in g] for g in got]
    good = quality_classifier.score(docs, quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(ids[1]) == sorted(r.doc_id for r in good.filter("kept").collect())
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    least = {}
    for r in sorted(got[1], key=lambda r: r["doc_id"]):
        least.setdefault(r["text"].encode().translate(lower), r["doc_id"])
    assert sorted(ids[2]) == sorted(least.values())
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) == len(set(ids[3])) and min(ids[2]) in ids[3]
    before, after = Counter(), Counter()
    for r in got[3]:
        before[r["source"]] += len(r["text"].encode().split())
    for r in got[4]:
        after[r["source"]] += len(r["text"].encode().split())
    assert abs(sum(after.values()) - sum(before.values())) <= len(before) and all(after[s] <= 3 * before[s] for s in before)
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(queries.vocabulary().source)
    texts = {r["doc_id"]: r["text"] for r in got[4]}
    for r in got[5]:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert sorted(texts) == sorted(r["doc_id"] for r in got[5])


def test_near_duplicates_against_brute_force(spark):
    """The stage's documents, with pairs planted near similarities 0.8, 0.85 and 0.9: what stays, against all pairs compared."""
    r, texts = random.Random(3), {}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        texts[d.doc_id] = d.text or ""
    start, planted = max(texts) + 1, {}
    for i in range(90):
        words = [f"p{r.getrandbits(40)}" for _ in range(r.randint(100, 300))]
        at, text = changed(r, words, (0.8, 0.85, 0.9)[i % 3])
        texts[start + 2 * i], texts[start + 2 * i + 1] = " ".join(words), text
        planted[start + 2 * i + 1] = at
    sets, of = {}, {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        of[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets[of[k]] = min(k, sets.get(of[k], k))
    root, held, common = {s: s for s in sets}, defaultdict(list), Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for s in sets:
        common.clear()
        for x in s:
            common.update(held[x])
            held[x].append(s)
        for t, n in common.items():
            if 9 * n >= 4 * (len(s) + len(t)):
                root[find(s)] = find(t)
    least = {}
    for s, k in sets.items():
        least[find(s)] = min(k, least.get(find(s), k))
    stay = {d.doc_id for d in corpus_pipeline.near(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF).collect()}
    want = set(least.values())
    dropped = set(texts) - want
    assert len(dropped) >= 90 and want <= stay  # nothing is dropped that brute force keeps
    assert len(stay - want) <= 0.03 * len(dropped)
    assert all(k not in stay for k, at in planted.items() if at >= 0.9)
