"""Data contracts: each check is one or two aggregates returning a one-row (or one-per-group) report;
:func:`require` turns a failed report into an error at an explicit action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import cell_index, reasons
from gridwright.operators.knn import nearest_distance


class ContractError(ValueError):
    pass


def require(report: DataFrame, column: str = "violations") -> DataFrame:
    """Raise when any report row lists a violation; return the report otherwise."""
    bad = report.filter(F.size(column) > 0).limit(5).collect()
    if bad:
        raise ContractError("; ".join(str(r.asDict()) for r in bad))
    return report


def points_report(df: DataFrame, by: Sequence[str] = ("band",), min_train: int = 24) -> DataFrame:
    """Point-table contract per band: ids, finite coordinates, roles, labels, 1 m group leakage."""
    by = list(by)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    train, quer = F.col("role") == "train", F.col("role") == "query"
    ids = df.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n"), F.first("band").alias("band"))
    dup = ids.filter("_n > 1 or point_id is null").groupBy(*by).agg(F.count(F.lit(1)).alias("bad_ids"))
    groups = df.groupBy(*by, cell_index(F.col("x"), 1).alias("_gx"), cell_index(F.col("y"), 1).alias("_gy")).agg(
        F.bool_or(train).alias("_t"), F.bool_or(quer).alias("_q"))
    shared = groups.groupBy(*by).agg(F.count_if(F.col("_t") & F.col("_q")).alias("shared_groups"))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(train).alias("train_n"), F.count_if(quer).alias("query_n"),
        F.count_if(~(finite("x") & finite("y") & finite("z"))).alias("bad_xyz"),
        F.count_if(~F.coalesce(train | quer, F.lit(False))).alias("bad_role"),
        F.count_if(train & ~finite("observed_dbm")).alias("train_without_label"),
        F.count_if(quer & F.col("observed_dbm").isNotNull()).alias("query_with_label"))
    t = base.join(dup, by, "left").join(shared, by, "left").fillna(0, ["bad_ids", "shared_groups"])
    return t.withColumn("violations", reasons(
        (F.col("bad_ids") > 0, "IDS_NOT_UNIQUE"), (F.col("bad_xyz") > 0, "COORDINATES_NOT_FINITE"),
        (~F.col("band").isin("n41", "n79"), "UNKNOWN_BAND"), (F.col("bad_role") > 0, "UNKNOWN_ROLE"),
        ((F.col("train_n") < min_train) | (F.col("query_n") < 1), "TOO_FEW_ROWS"),
        (F.col("train_without_label") > 0, "TRAIN_LABEL_MISSING"), (F.col("query_with_label") > 0, "QUERY_LABEL_PRESENT"),
        (F.col("shared_groups") > 0, "SHARED_POSITION_GROUP")))


def fit_query_report(fit: DataFrame, query: DataFrame, by: Sequence[str], min_fit: int = 3) -> DataFrame:
    """No shared id, every query at least 1e-8 m (3-D) from the fit rows, no query label column."""
    if "observed_dbm" in query.columns:
        raise ContractError("query rows must not carry labels")
    common = fit.select(*by, "point_id").join(query.select(*by, "point_id"), [*by, "point_id"], "left_semi").groupBy(*by).agg(
        F.count(F.lit(1)).alias("shared_ids"))
    near = nearest_distance(query, fit, by, feats=("x", "y", "z")).groupBy(*by).agg(F.min("nearest_m").alias("minimum_m"))
    sizes = fit.groupBy(*by).agg(F.count(F.lit(1)).alias("fit_n"))
    t = sizes.join(near, list(by), "left").join(common, list(by), "left").fillna(0, ["shared_ids"])
    return t.withColumn("violations", reasons(
        (F.col("fit_n") < min_fit, "TOO_FEW_FIT_ROWS"), (F.col("minimum_m").isNull(), "NO_QUERY_ROWS"),
        (F.col("shared_ids") > 0, "SHARED_IDS"), (F.col("minimum_m") < 1e-8, "SHARED_COORDINATES")))


def gain_report(points: DataFrame, gains: DataFrame) -> DataFrame:
    """Gains cover exactly the points under every configuration; no infinity; first configuration neutral."""
    n_configs = gains.agg(F.count_distinct("config_id").alias("configs"))
    per = gains.groupBy("point_id").agg(F.count(F.lit(1)).alias("_g"), F.count_if(F.abs("gain_db") == float("inf")).alias("_inf"),
                                        F.count_if(F.col("los").isNull()).alias("_los"))
    ids = points.groupBy("point_id").agg(F.count(F.lit(1)).alias("_p"))
    both = ids.join(per, "point_id", "full_outer").crossJoin(F.broadcast(n_configs))  # one row
    first = gains.agg(F.min_by("config_id", "config_ord").alias("first_id"), F.min_by("family", "config_ord").alias("first_family"))
    t = both.agg(
        F.max("configs").alias("configs"), F.count_if(F.col("_g").isNull()).alias("points_without_gain"),
        F.count_if(F.col("_p").isNull()).alias("gain_without_point"), F.count_if(F.col("_g") != F.col("configs")).alias("ragged_points"),
        F.sum("_inf").alias("infinite_gains"), F.sum("_los").alias("missing_los")).crossJoin(F.broadcast(first))  # one row each
    return t.withColumn("violations", reasons(
        (F.col("points_without_gain") + F.col("gain_without_point") > 0, "ID_MISMATCH"), (F.col("ragged_points") > 0, "RAGGED"),
        (F.col("infinite_gains") > 0, "INFINITE_GAIN"), (F.col("missing_los") > 0, "LOS_MISSING"),
        ((F.col("first_id") != "AUTO_BASE") | (F.col("first_family") != "BASE"), "FIRST_CONFIG_NOT_NEUTRAL")))


def invariant_report(df: DataFrame, unit: Sequence[str], variant: str, variants: int, cols: Sequence[str]) -> DataFrame:
    """Per unit problems: missing or repeated variants, columns that differ (NULL counts as a value)."""
    differs = [F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")) for c in cols]
    t = df.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct(variant).alias("_variants"),
        *[d.alias(f"_d_{c}") for c, d in zip(cols, differs)])
    return t.select(*unit, reasons(
        (F.col("_variants") != variants, "VARIANT_MISSING"), (F.col("_rows") != F.col("_variants"), "DUPLICATE_VARIANT"),
        *[(F.col(f"_d_{c}") > 1, f"DIFFERS:{c}") for c in cols]).alias("violations"))


def matched_arms_report(manifests: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Arms of one comparison: equal contract fields, unique ids, one uniform, one semantic, three shuffles."""
    kind = lambda k: F.count_if(F.col("arm_kind") == k)
    t = manifests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("arms"), F.count_distinct("arm_id").alias("_ids"),
        F.count_if(F.col("status") != "COMPLETED").alias("_open"), kind("uniform").alias("_u"), kind("semantic").alias("_s"),
        kind("label_shuffle").alias("_l"),
        *[(F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f"_f_{f}") for f in fields])
    return t.select(*by, "arms", reasons(
        (F.col("arms") < 5, "TOO_FEW_ARMS"), (F.col("_open") > 0, "INCOMPLETE_ARM"), (F.col("_ids") != F.col("arms"), "DUPLICATE_ARM"),
        ((F.col("_u") != 1) | (F.col("_s") != 1) | (F.col("_l") < 3), "WRONG_ARM_KINDS"),
        *[(F.col(f"_f_{f}") > 1, f"UNMATCHED:{f}") for f in fields]).alias("violations"))


def aligned_join(left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str = "one_to_one") -> DataFrame:
    """Inner join after checking key uniqueness (right side only for many_to_one) and equal key sets."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError("validate must be 'one_to_one' or 'many_to_one'")
    ls = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    rs = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    report = ls.join(rs, list(keys), "full_outer").agg(
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched_keys"),
        F.count_if(F.col("_l") > 1).alias("left_repeats"), F.count_if(F.col("_r") > 1).alias("right_repeats"))
    report = report.withColumn("violations", reasons(
        (F.col("unmatched_keys") > 0, "KEY_SETS_DIFFER"),
        ((F.col("left_repeats") > 0) & F.lit(validate == "one_to_one"), "LEFT_KEYS_REPEAT"), (F.col("right_repeats") > 0, "RIGHT_KEYS_REPEAT")))
    require(report)
    return left.join(right, list(keys))


def strict_new_cell(query: DataFrame, train: DataFrame, by: Sequence[str], size: float) -> DataFrame:
    """Query rows whose cell holds no train row."""
    cells = train.select(*by, cell_index(F.col("x"), size).alias("_cx"), cell_index(F.col("y"), size).alias("_cy")).distinct()
    q = query.withColumn("_cx", cell_index(F.col("x"), size)).withColumn("_cy", cell_index(F.col("y"), size))
    return q.join(cells, [*by, "_cx", "_cy"], "left_anti").drop("_cx", "_cy")


def leakage_report(train: DataFrame, query: DataFrame, by: Sequence[str], size: float = 1.0) -> DataFrame:
    """Shared ids and shared position cells between the two sides, per split."""
    cell = lambda df: df.select(*by, cell_index(F.col("x"), size).alias("cx"), cell_index(F.col("y"), size).alias("cy")).distinct()
    ids = train.select(*by, "point_id").intersect(query.select(*by, "point_id")).groupBy(*by).agg(F.count(F.lit(1)).alias("shared_ids"))
    cells = cell(train).intersect(cell(query)).groupBy(*by).agg(F.count(F.lit(1)).alias("shared_cells"))
    t = train.select(*by).distinct().join(ids, list(by), "left").join(cells, list(by), "left").fillna(0, ["shared_ids", "shared_cells"])
    return t.withColumn("violations", reasons((F.col("shared_ids") > 0, "SHARED_IDS"), (F.col("shared_cells") > 0, "SHARED_CELLS")))


def restrict_to(df: DataFrame, core: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(core.select(*keys).distinct(), list(keys), "left_semi")


def id_set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys on one side only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def coordinate_audit(meta: DataFrame) -> DataFrame:
    """Notes and pass flag of a coordinate declaration held in a MAP column ``meta``."""
    get = lambda k: F.trim(F.coalesce(F.col("meta")[k], F.lit("")))
    crs, axis, unit = get("crs"), F.upper(get("axis_order")), F.lower(get("unit"))
    datum, origin = get("vertical_datum"), F.lower(get("origin_status"))
    # Accepted axis orders and the local origin fields.
    axis_bad = ~axis.isin("ENU", "EUN", "XYZ", "YUP", "ZUP")
    unit_bad = ~unit.isin("m", "meter", "metre")
    local = F.lower(crs).isin("local_enu", "enu")
    fields = ("origin_latitude_deg", "origin_longitude_deg", "origin_altitude_m")
    raw = lambda k: F.coalesce(F.col("meta")[k], F.lit(""))
    missing = F.filter(F.array(*[F.when(raw(f) == "", F.lit(f)) for f in fields]), lambda v: v.isNotNull())
    shown = lambda v: F.when(v == "", "<empty>").otherwise(v)
    candidate = ~origin.contains("survey") | origin.contains("not_") | origin.contains("candidate") | origin.contains("review")
    notes = F.filter(F.array(
        F.when(crs == "", F.lit("missing CRS declaration")),
        F.when(axis_bad, F.concat(F.lit("unsupported or missing axis_order: "), shown(axis))),
        F.when(unit_bad, F.concat(F.lit("coordinate unit must be metres after normalization, got "), shown(unit))),
        F.when(origin == "", F.lit("origin status is undeclared; absolute placement requires review")).when(
            candidate, F.lit("origin is a candidate or non-survey reference; keep REVIEW_REQUIRED")),
        F.when(local & (F.size(missing) > 0), F.concat(F.lit("local ENU origin is incomplete: "), F.array_join(missing, ", "))),
    ), lambda v: v.isNotNull())
    passed = ~((crs == "") | axis_bad | unit_bad | (local & (F.size(missing) > 0)))
    return meta.select("*", crs.alias("crs"), axis.alias("axis_order"), unit.alias("unit"),
                       F.when(datum != "", datum).alias("vertical_datum"), passed.alias("passed"), notes.alias("notes"))
