from tallyframe.llm import language_id
from tallyframe.llm.language_id import has_letter, identify, windows_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_windows_hold_the_whole_text():
    for size in (0, 1, 255, 256, 257, 1000):
        text = bytes(range(1, 256)) * 4
        assert windows_of(text[:size]).tobytes().rstrip(b"\0") == text[:size]
    assert has_letter("123 ñ".encode()) and has_letter(b"1a") and not has_letter("12 · ¡".encode())


def test_odd_rows(odd, documents):
    rows = identify(odd).collect()
    assert len(rows) == 13
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 11):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[None].held_out is False
    assert by_id[9].lang_pred != "und"  # a row without language is predicted
    assert identify(odd.limit(0)).count() == 0
    nothing = identify(documents((1, "some text", "a", None))).collect()
    assert nothing[0].lang_pred == "und"


def test_held_out_rows_are_not_learned_from(documents):
    from zlib import crc32

    held = [i for i in range(400) if crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "some words here", "a", "zz" if i in held else "en") for i in range(400)]
    assert {r.lang_pred for r in identify(documents(*rows)).collect()} == {"en"}
    assert language_id.HELD_OUT == 2
