import pytest

from tallyframe.operators import search, search_index as index


@pytest.fixture
def shelf(spark, frame, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "index")

    def add(*texts):
        frame("title string, pages long", *texts).drop("row_id").coalesce(1).write.mode("append").parquet(folder)

    def update():
        return index.update_index(spark, path, folder)

    def found(needle, columns=None):
        rows = index.search_indexed(spark, path, folder, needle, columns)
        titles = sorted(r.title or "" for r in rows.collect())
        plain = search.search_rows(spark.read.parquet(folder), needle, columns or ["title", "pages"])
        assert titles == sorted(r.title or "" for r in plain.collect())
        return titles, len(rows.inputFiles())

    return add, update, found, tmp_path


def test_files_without_the_trigrams_are_not_read(shelf):
    add, update, found, _ = shelf
    add(("Harbour Lights", 120), ("Émile et le phare", 31415), (None, None), ("", 7))
    add(("Salt", 98), ("𝄞 clefs 𝄞𝄞𝄞", 55))
    assert update() == 2 and update() == 0
    assert found("HARB") == (["Harbour Lights"], 1)
    assert found("émile") == (["Émile et le phare"], 1)
    assert found("𝄞𝄞𝄞") == (["𝄞 clefs 𝄞𝄞𝄞"], 1)
    assert found("3141") == (["Émile et le phare"], 1)
    assert found("no such title") == ([], 0)
    assert found("al") == (["Salt"], 2)
    assert found("")[1] == 2
    assert found("harbour lights" * 30)[0] == []
    add(("Harbour Master", 3))
    assert found("harbour m") == (["Harbour Master"], 1)
    assert update() == 1 and found("harbour") == (["Harbour Lights", "Harbour Master"], 2)


def test_files_that_go_and_columns(shelf):
    add, update, found, tmp_path = shelf
    add(("aaaa", 1))
    add(("zebra", 1234567))
    update()
    for file in (tmp_path / "in").glob("*.parquet"):
        if found("zebra")[1] and b"zebra" in file.read_bytes():
            file.unlink()
            break
    assert found("zebra") == ([], 0) and update() == 0 and found("aaa") == (["aaaa"], 1)
    assert found("aaa", ["title"]) == (["aaaa"], 1)
    with pytest.raises(ValueError):
        found("x", ["shelf"])


def test_long_text(shelf):
    add, update, found, _ = shelf
    add(("x" * 200_000 + "needle", 1), ("plain", 2))
    update()
    assert found("xneedle")[1] == 1 and found("needlex") == ([], 0)


def test_bit_maps_sort_distinct_hashes_only(spark, frame):
    # Many rows of one text give one file's hashes again and again: the sort under the bit maps sees each once.
    rows = frame("title string", *[("harbour lights",)] * 200).drop("row_id")
    rows = rows.withColumn("_source_file", index.F.lit("f"))
    maps = index._file_maps(rows, ["title"])
    plan = maps._jdf.queryExecution().executedPlan().toString()
    sort_input = plan.split("Sort [")[-1]
    assert "HashAggregate" in sort_input
    got = {(r.piece, tuple(r.bits)) for r in maps.collect()}
    once = index._file_maps(rows.limit(1), ["title"])
    assert got == {(r.piece, tuple(r.bits)) for r in once.collect()}
