import re

import __spark_entry__ as contract
import corpus_pipeline
from conftest import SMALL

from tallyframe.llm import quality_rules
from tallyframe.llm.common import staged, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_queries_are_registered():
    names = set(contract.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    outputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(staged(stage(spark, outputs[-1], SMALL), f"test-{name}"))
    start, good, single, clean, mixed, packed = outputs
    assert all(df.columns == docs.columns for df in outputs[:-1])
    kept = quality_rules.quality_table(start, table(spark, SMALL, "labels")).where("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in kept.collect())
    sets = [
        (r.doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        for r in good.collect()
        for w in [r.text.lower().split()]
    ]
    left = {r.doc_id for r in single.collect()}
    for a, x in sets:
        similar = [b for b, y in sets if len(x & y) >= 0.8 * len(x | y)]
        assert a in left or min(similar) < a
        assert a not in left or not any(b in left for b in similar if b != a)
    texts = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert "token =" not in r.text or "<secret>" in r.text
        assert r.text == texts[r.doc_id] or "<secret>" in r.text
        assert r.n_chars == len(r.text)
    words = {r.doc_id: WORD.findall(r.text) for r in clean.collect()}
    for r in mixed.collect():
        part, whole = WORD.findall(r.text), words[r.doc_id]
        assert any(whole[i : i + len(part)] == part for i in range(len(whole) - len(part) + 1))
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed.collect()) - 1.5 * sum(map(len, words.values()))) < 20
    assert packed.where("start = 0").count() == mixed.count()


def test_stages_on_odd_rows(spark, odd, labels, tmp_path):
    labels((1, 1, 0, "t")).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, rows, str(tmp_path))
            assert df.count() >= 0
            if name != "packing":
                assert df.columns == odd.columns


def test_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    lengths = {}
    for r in rows:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
