import re
from collections import Counter, defaultdict

import corpus_pipeline
from strophe.llm.common import materialize

from .test_operators import check_pack, components_of, shingles


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact_dedup", "near_dedup", "mixture", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, small)
        if name == "packing":
            break
        assert docs.columns == before.columns
        docs = materialize(docs, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept["language"]) == 200
    groups = defaultdict(list)
    for d, t in kept["language"].items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d))
    assert set(kept["exact_dedup"]) == {min(m)[1] for m in groups.values()}
    ids = sorted(kept["exact_dedup"])
    parts = components_of([shingles(kept["exact_dedup"][i], 5) for i in ids])
    assert set(kept["near_dedup"]) == {ids[c] for c in parts}
    assert Counter(kept["mixture"]) == Counter(kept["near_dedup"])
    rows = docs.collect()
    check_pack(rows, list(kept["mixture"].items()))
    order = [r.sequence_order for r in rows]
    assert order == sorted(order) and len(order) > 0
