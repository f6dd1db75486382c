import pytest

from gridwright.operators import experts, regions


def levels_at(spark, col):
    cells = spark.createDataFrame([("z", 0, col, None), ("z", 0, 1, 5.0), ("z", 0, 2, 5.0)], "zone string, row long, col long, height double")
    levels = spark.createDataFrame([("z", [1.0, 5.0])], "zone string, levels array<double>")
    return regions.assign_levels(cells, levels, spark.createDataFrame([("z", 1)], "zone string, min_cells long")).collect()


def test_cells_come_back_as_they_were(spark):
    assert {(r.row, r.col, r.level) for r in levels_at(spark, 2**24 - 1)} == {(0, 2**24 - 1, 1), (0, 1, 1), (0, 2, 1)}


def test_cells_beyond_the_packed_range_are_refused(spark):
    with pytest.raises(Exception, match="outside the packed range"):
        levels_at(spark, 16_777_221)


def test_components_refuse_columns_beyond_their_span(spark):
    with pytest.raises(Exception, match="cell out of range"):
        regions.components(spark.createDataFrame([(0, 2**31)], "row long, col long"), []).collect()


def test_expert_pool_keeps_queries_of_a_split_without_fit_rows(spark):
    rows = [("a", i, "fit" if i % 4 else "query", float(i * 7 % 50), float(i * 13 % 60), 1.5, 10.0 + i, -70.0 - i % 9, i % 2 == 0, -75.0 - i % 11) for i in range(60)]
    rows += [("b", 100, "query", 1.0, 2.0, 1.5, 9.0, -70.0, True, -71.0)]
    data = spark.createDataFrame(rows, "split string, point_id long, role string, x double, y double, z double, d3 double, raw double, los boolean, observed_dbm double")
    out = experts.expert_pool(data, ["split"]).filter("split = 'b'").collect()
    assert len(out) == len(experts.EXPERTS) and all(r.pred is None for r in out)


@pytest.mark.parametrize("key", ["_l", "label", "node", "a", "local"])
def test_components_across_tiles_with_any_key_name(spark, key):
    # two bars over the tile border at column 256, one cell between them and the next key's bar
    cells = [(k, row, col) for k in (0, 1) for row in (3, 5) for col in range(250, 262)]
    found = regions.components(spark.createDataFrame(cells, f"{key} long, row long, col long"), [key])
    assert found.columns == [key, "row", "col", "component"]
    assert {tuple(r) for r in found.collect()} == {(k, row, col, row * 2**31 + 250) for k, row, col in cells}
