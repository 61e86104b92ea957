import zlib

import numpy as np
import pytest
from conftest import SMALL

from tallyframe.llm.packing import Encoder, Packer, pack, vocabulary


def check(rows, length=4096):
    """Every id in one piece, sequences gapless, full or a power of two."""
    pieces, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at and size > 0
            at += size
        assert at == length or (at < length and at & (at - 1) == 0)
    return pieces


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(3)
    rows = pack(docs, with_ids=True).collect()
    check(rows)
    for doc in docs.collect():
        parts = sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == [*tokenizer.encode(doc.text, add_special_tokens=False).ids, 2]
        at = 0
        for r in parts:
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(r.ids))
            at += r.length


TEXTS = [
    "", " ", "a", "It's, isn't it? I'LL we've", "<|endoftext|> x<|startoftext|>y", "é ́ e", "İ ſ K Å",
    "tab\tand no-break space\x1cfs", "漢字 かな 한글", "\U0001f600‍\U0001f468", "x" * 300, "a\x00b", "1,234.5 ½ ²",
]


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    for _ in range(2):  # the second time from memory
        for text, ids in zip(TEXTS, encoder.encode([t.encode() for t in TEXTS])):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr("tallyframe.llm.packing.CACHED_WORDS", 3)
    encoder = Encoder(vocabulary())
    texts = [b"one two three four", b"five six", b"one two"]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.encode([t])[0].tolist() for t in texts]


@pytest.mark.parametrize("most", [2048, 5])
def test_packer_keeps_every_id(most):
    rng = np.random.default_rng(3)
    out = []
    packer = Packer(out.append, 64, most)
    docs = [rng.integers(0, 1000, size).astype(np.uint32) for size in rng.integers(1, 200, 500)]
    for i, ids in enumerate(docs):
        packer.add(i, ids)
    packer.flush()
    back = {}
    for window in out:
        filled = sum(len(ids) for _, _, ids, _ in window)
        assert filled == 64 or filled & (filled - 1) == 0
        for doc, start, ids, total in window:
            assert total == len(docs[doc])
            back.setdefault(doc, {})[start] = ids
    for i, ids in enumerate(docs):
        assert np.concatenate([back[i][s] for s in sorted(back[i])]).tolist() == ids.tolist()


def test_least_squares_choice():
    packer = Packer(lambda window: None, 10)
    sizes = [6, 6, 3]
    for i, size in enumerate(sizes):
        packer.add(i, np.zeros(size, np.uint32))
    # Two windows at 6: joining one of them (4 -> 1 + 1) beats a new window (4 -> 4 + 1).
    assert {level: int(packer.counts[level]) for level in range(11) if packer.counts[level]} == {6: 1, 9: 1}
    packer.add(3, np.zeros(1, np.uint32))
    assert packer.counts[9] == 0  # closing a window takes its square away


def test_odd_rows(odd):
    rows = pack(odd).collect()
    check(rows)
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        assert (by_id[i].length, by_id[i].doc_tokens) == (1, 1)
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * by_id[7].doc_tokens
    assert pack(odd.limit(0)).count() == 0
