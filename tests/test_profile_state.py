import pytest

from tallyframe.operators import profile, profile_state as states_of


def save(frame, folder, *rows, schema="weight double, tag string"):
    frame(schema, *rows).drop("row_id").coalesce(1).write.mode("append").parquet(folder)


EXACT = ("column", "dtype", "row_count", "null_count", "null_pct", "unique_count", "min_length", "max_length", "min_value", "max_value")


def test_only_new_files_are_read(spark, frame, rows, tmp_path):
    folder, path, seen = str(tmp_path / "in"), str(tmp_path / "states"), []

    def read(spark, paths):
        seen.append(len(paths))
        return states_of.read_positions(spark, paths)

    def agrees():
        merged = states_of.merged_profile(states_of.file_states(spark, path))
        direct = profile.profile_columns(spark.read.parquet(folder))
        assert merged.columns == direct.columns and rows(merged, *EXACT) == rows(direct, *EXACT)

    save(frame, folder, (1.5, "a"), (None, "b"), (float("nan"), "a"))
    assert states_of.update_profile(spark, path, folder, read=read) == 1
    agrees()
    save(frame, folder, (-2.0, None), (1.5, "ccc"))
    save(frame, folder, (0.0, "b"))
    assert states_of.update_profile(spark, path, folder, read=read) == 2
    agrees()
    assert states_of.update_profile(spark, path, folder, read=read) == 0 and seen == [1, 2]

    gone = sorted((tmp_path / "in").glob("*.parquet"))[0]
    gone.unlink()
    assert states_of.update_profile(spark, path, folder, read=read) == 0 and seen == [1, 2]
    agrees()


def test_examples_and_quantiles(spark, frame, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "states")
    values = [(float(i % 1000), f"t{i // 100}") for i in range(4000)]
    save(frame, folder, *values)
    save(frame, folder, *[(None, "t0"), (None, None)])
    states_of.update_profile(spark, path, folder)
    states = states_of.file_states(spark, path)
    found = {r.column: r for r in states_of.merged_examples(states, 3).collect()}
    assert set(found["tag"].examples) <= {"t0", "t1", "t2"} and len(found["tag"].examples) == 3
    assert found["weight"].examples == ["0.0", "1.0", "2.0"]
    (row,) = states_of.merged_quantiles(states).collect()
    assert row.column == "weight" and all(abs(q - s) <= 30 for q, s in zip(row.quantiles, (250, 500, 750)))
    with pytest.raises(ValueError):
        states_of.merged_examples(states, 50)


def test_files_without_rows_or_values(spark, frame, rows, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "states")
    save(frame, folder)
    assert states_of.update_profile(spark, path, folder) == 1
    assert states_of.update_profile(spark, path, folder) == 0
    states = states_of.file_states(spark, path)
    assert rows(states_of.merged_profile(states), "row_count", "unique_count", "null_pct") == [(0, 0, 0.0)] * 2
    save(frame, folder, (None, None))
    states_of.update_profile(spark, path, folder)
    states = states_of.file_states(spark, path)
    assert rows(states_of.merged_profile(states), "row_count", "unique_count", "null_pct") == [(1, 0, 100.0)] * 2
    assert states_of.merged_quantiles(states).first().quantiles is None
    assert [r.examples for r in states_of.merged_examples(states).collect()] == [[], []]


def test_other_types_and_broken_updates(spark, frame, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "states")
    save(frame, folder, (1.0, "a"))
    states_of.update_profile(spark, path, folder)
    spark.read.parquet(f"{path}/data").drop("batch").write.parquet(f"{path}/data/batch=broken")
    assert states_of.file_states(spark, path).count() == 2
    save(frame, str(tmp_path / "other"), ("x", "a"), schema="weight string, tag string")
    with pytest.raises(ValueError, match="weight"):
        states_of.update_profile(spark, path, str(tmp_path / "other"))
