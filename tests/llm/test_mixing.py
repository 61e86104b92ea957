import re

import numpy as np
from conftest import SMALL

from tallyframe.llm.mixing import draw_shards, mix, mix_table, mixed_documents, permuted, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_permutations():
    for size in (1, 2, 3, 5, 64, 1000, 4097):
        index = np.arange(size)
        image = permuted(index, size, 7)
        assert sorted(image) == list(index)
        assert (permuted(image, size, 7, inverse=True) == index).all()
    assert (permuted(np.arange(1000), 1000, 7) != permuted(np.arange(1000), 1000, 8)).any()


def test_targets_stop_at_twice_the_size():
    found = targets([10, 1000, 1000, 1000])
    assert found[0] == 20
    assert abs(found.sum() - 1.5 * 3010) < 1e-6
    assert (found <= [20, 2000, 2000, 2000]).all()
    assert list(targets([])) == []
    assert list(targets([0, 0])) == [0, 0]


def test_shards_deal_out_every_slot():
    drawn = draw_shards([1000, 10, 0, 500], 16, 0)
    assert list(drawn.sum(0)) == [1000, 10, 0, 500]
    assert drawn.sum(1).max() - drawn.sum(1).min() <= 1


def test_sources_meet_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in mix_table(docs, block_words=128).collect()}
    again = {r.doc_id: r for r in mix_table(docs.repartition(7), block_words=128).collect()}
    assert rows == again
    taken, target = {}, {}
    for row in docs.collect():
        found = rows[row.doc_id]
        assert found.size == len(WORD.findall(row.text))
        assert 0 <= found.taken <= 2 * found.size
        taken[row.source] = taken.get(row.source, 0) + found.taken
        target[row.source] = found.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)


def test_blocks_are_taken_once_a_round(spark):
    _, _, parts = mix(spark.read.parquet(f"{SMALL}/documents.parquet"), block_words=100)
    rows = parts.collect()
    places = [(r.source, r.start + r["from"], r["round"]) for r in rows]
    assert len(set(places)) == len(places)
    assert {r.shard for r in rows} == set(range(64))


def test_odd_rows(odd):
    rows = mix_table(odd, block_words=16).collect()
    assert len(rows) == 13
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    null_source = [r for r in rows if r.doc_id in (6, 8)]
    assert {r.source_size for r in null_source} == {30_006}
    texts = mixed_documents(odd, block_words=16)
    assert texts.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in texts.collect()) == sum(r.taken for r in rows)


def test_empty_tables(odd, documents):
    assert mix_table(odd.limit(0)).count() == 0
    assert mixed_documents(odd.limit(0)).count() == 0
    assert [r.taken for r in mix_table(documents((1, None), (2, ""))).collect()] == [0, 0]


def test_texts_are_cut_at_words(documents):
    docs = documents((1, " one  two\tthree four five "), (2, "six seven"))
    rows = mixed_documents(docs, block_words=3).collect()
    for row in rows:
        assert row.text in " one  two\tthree four five " or row.text in "six seven"
        assert row.n_chars == len(row.text)
