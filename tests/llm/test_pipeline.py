"""The pipeline's stages one by one, against plain Python."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from placelens.llm.common import materialise


def test_stages(spark, folder):
    assert pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], folder)))
    for before, after in zip(kept[:4], kept[1:5], strict=True):
        assert before.columns == after.columns
    raw, good, single, clean, mixed, packed = [d.collect() for d in kept]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids = {r.doc_id for r in good}
    assert all(r.doc_id in ids for r in raw if labels.get(r.doc_id) == 1 and len(r.text.split()) >= 60)
    assert {r.doc_id for r in single} <= ids and len(single) < len(good)
    assert len({r.text for r in single}) == len(single)
    assert [r.doc_id for r in sorted(clean)] == [r.doc_id for r in sorted(single)]
    texts = {r.doc_id: r.text for r in single}
    changed = [r for r in clean if r.text != texts[r.doc_id]]
    assert changed and all("[secret]" in r.text and r.n_chars == len(r.text) for r in changed)
    uses, words, taken = Counter(r.doc_id for r in mixed), Counter(), Counter()
    assert max(uses.values()) <= 3
    for r in clean:
        words[r.source] += len(r.text.split())
        taken[r.source] += uses[r.doc_id] * len(r.text.split())
    longest = max(len(r.text.split()) for r in clean)
    for i, source in enumerate(sorted(words)):
        assert taken[source] <= 3 * words[source]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(words))}
    level = max(taken[s] / weight[s] for s in words)
    for s in words:
        assert abs(taken[s] - min(level * weight[s], 3 * words[s])) <= 2 * longest
    pieces = defaultdict(set)
    for r in packed:
        pieces[r.sequence_id].add((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 for p in pieces.values())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == uses
