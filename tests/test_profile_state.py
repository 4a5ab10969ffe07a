"""States of parts, merged, against the profile of the whole table."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import profile as P
from veilframe.operators import profile_state as PS
from veilframe.operators import risk as K
from veilframe.plans.anonymize import fit

EXACT = ["total_count", "numeric_ratio", "boolean_ratio", "string_ratio", "num_min", "num_max", "is_integer", "num_range",
         "all_non_negative", "avg_string_length"]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for i in range(4000):
        text = [None, "", " ", "n/a", "yes", "12.5", "red", "blue"][i % 8]
        number = None if i % 11 == 0 else float("nan") if i % 997 == 5 else (0.0 if i % 2 else -0.0) if i % 3 else i / 7
        rows.append((i, "abc"[i % 3] if i < 3990 else None, text, number, i % 2 == 0, 7))
    return spark.createDataFrame(rows, "id long, part string, t string, x double, b boolean, same int").repartition(4)


def rows_of(df, columns):
    out = {}
    for r in df.collect():
        out[r["column"]] = [round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns]
    return out


COLUMNS = ["id", "t", "x", "b", "same"]


def test_merged_parts_equal_the_whole(spark, mixed):
    states = PS.profile_state(mixed, COLUMNS, ["part"])
    assert states.count() == 4 * len(COLUMNS)  # a part may be NULL
    whole = P.profile(mixed, COLUMNS)
    assert rows_of(PS.merged_profile(states), ["ord", *EXACT]) == rows_of(whole, ["ord", *EXACT])
    near = rows_of(PS.merged_profile(states), ["unique_count", "num_mean"])
    for column, (unique, mean) in rows_of(whole, ["unique_count", "num_mean"]).items():
        assert near[column][0] == pytest.approx(unique, rel=0.08, abs=2)
        assert near[column][1] == (None if mean is None else pytest.approx(mean))
    types = lambda p: {r["column"]: r["semantic_type"] for r in P.infer_types(p).collect()}
    assert types(PS.merged_profile(states)) == types(whole)


def test_merging_in_steps_and_adding_a_part(spark, mixed, tmp_path):
    path = str(tmp_path / "states")
    PS.profile_state(mixed.where("part = 'a'"), COLUMNS, ["part"]).write.parquet(path)
    PS.profile_state(mixed.where("part = 'b'"), COLUMNS, ["part"]).write.mode("append").parquet(path)
    first = PS.merge_states(spark.read.parquet(path))
    rest = PS.merge_states(PS.profile_state(mixed.where("part = 'c' OR part IS NULL"), COLUMNS, ["part"]))
    both = PS.merged_profile(first.unionByName(rest))
    assert rows_of(both, EXACT) == rows_of(P.profile(mixed, COLUMNS), EXACT)


def test_uniqueness_quantiles_and_frequent_values(spark, mixed):
    states = PS.profile_state(mixed, ["id", "same", "b"], ["part"])
    exact = {r["column"]: r["uniqueness"] for r in K.uniqueness(mixed, ["id", "same", "b"]).collect()}
    for r in PS.merged_uniqueness(states).collect():
        assert r["rows"] == 4000 and r["uniqueness"] == pytest.approx(exact[r["column"]], rel=0.08)
    for r in PS.merged_quantiles(states).where("column = 'id'").collect():
        assert r["value"] == pytest.approx(r["share"] * 4000, abs=0.03 * 4000)
    found = {(r["column"], r["item"]): r["count"] for r in PS.merged_frequent(states.where("column != 'id'")).collect()}
    assert found == {("same", "7"): 4000, ("b", "true"): 2000, ("b", "false"): 2000}


def test_empty_tables_and_parts(spark, mixed):
    none = mixed.where("id < 0")
    assert PS.profile_state(none, COLUMNS, ["part"]).count() == 0
    empty = PS.profile_state(none, COLUMNS)
    assert rows_of(empty, ["rows", "total_count"]) == {c: [0, 0] for c in COLUMNS}
    both = empty.unionByName(PS.profile_state(mixed, COLUMNS))
    assert rows_of(PS.merged_profile(both), EXACT) == rows_of(P.profile(mixed, COLUMNS), EXACT)
    assert PS.merged_quantiles(empty).count() == PS.merged_frequent(empty).count() == 0


def test_fit_reads_states(spark, users):
    states = PS.profile_state(users, by=["gender"])
    args = dict(key=["user_id"], secret="s", exclude=["gender"], overrides={"gender": "string"})
    with pytest.raises(ValueError, match="no state"):
        fit(users, states=states, **args)
    states = PS.profile_state(users.withColumn("half", F.col("user_id").cast("int") % 2), users.columns, ["half"])
    assert fit(users, states=states, **args).columns == fit(users, **args).columns
