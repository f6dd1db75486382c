"""Point, gain, configuration and annotation tables; result sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_SCHEMA = T.StructType([
    T.StructField("point_id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()), T.StructField("band", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("observed_dbm", T.DoubleType()),
])
EXTRA_FIELDS = (("date", T.StringType()), ("trajectory_group", T.StringType()), ("segment_group", T.StringType()))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN never enters a DataFrame: it means "absent" in the files and is NULL here."""
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real})


def read_points(spark: SparkSession, path: str, extra: Sequence[str] = (), check: bool = True) -> DataFrame:
    """CSV (with header) or Parquet point table under a fixed schema; ``check`` runs the contract."""
    from gridwright.operators.contracts import points_report, require
    schema = T.StructType(POINT_SCHEMA.fields + [T.StructField(n, t) for n, t in EXTRA_FIELDS if n in extra])
    if path.endswith(".parquet"):
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    df = nan_to_null(df)
    if "date" in extra:
        df = df.withColumn("date", F.lpad("date", 4, "0"))
    if check:
        require(points_report(df))
    return df


def expand_gains(receivers: DataFrame, points: DataFrame, config_ids: Sequence[str], families: Sequence[str]) -> DataFrame:
    """``receivers(receiver_id, gains ARRAY<DOUBLE> in configuration order, los)`` and
    ``points(point_id, receiver_id)`` -> the long gain table."""
    ids = F.array(*[F.lit(c) for c in config_ids])
    fams = F.array(*[F.lit(c) for c in families])
    flat = receivers.filter(
        F.when(F.size("gains") == len(config_ids), True).otherwise(F.raise_error(F.lit("gain array length differs from the catalog")).cast("boolean"))
    ).select("receiver_id", "los", F.posexplode("gains").alias("config_ord", "gain_db"))
    flat = flat.select("receiver_id", "los", "config_ord", ids[F.col("config_ord")].alias("config_id"), fams[F.col("config_ord")].alias("family"),
                       F.when(~F.isnan("gain_db"), F.col("gain_db")).alias("gain_db"))
    return points.select("point_id", "receiver_id").join(flat, "receiver_id").drop("receiver_id")


def distinct_receivers(points: DataFrame, cols: Sequence[str] = ("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """(receivers: receiver_id, coordinates), (map: point_id, receiver_id); ids are 0.. in coordinate order."""
    from gridwright.functions.ranking import global_position
    from gridwright.session import settle
    unique = global_position(points.select(*cols).distinct(), [], [F.col(c) for c in cols], "_pos")
    unique = settle(unique.select((F.col("_pos") - 1).alias("receiver_id"), *cols))
    return unique, points.select("point_id", *cols).join(unique, list(cols)).select("point_id", "receiver_id")


def read_gains(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def config_catalog(spark: SparkSession) -> DataFrame:
    """Thirteen material configurations: the neutral base, 3 x 3 facade/glass levels, three facade labels."""
    # Permittivity and conductivity levels and facade labels.
    facade = [("F_L", 3.0, 0.015), ("F_M", 6.0, 0.050), ("F_H", 10.0, 0.150)]
    glass = [("G_L", 4.0, 0.005), ("G_M", 7.0, 0.020), ("G_H", 10.0, 0.080)]
    labels = ["concrete", "marble", "brick"]
    value = "struct<eps:double,sigma:double,label:string>"
    frame = lambda rows: spark.createDataFrame(rows, "ord int, key string, eps double, sigma double")
    f = frame([(i, *r) for i, r in enumerate(facade)])
    g = frame([(i, *r) for i, r in enumerate(glass)])
    pick = lambda a: F.struct(F.col(f"{a}.eps").alias("eps"), F.col(f"{a}.sigma").alias("sigma"), F.lit(None).cast("string").alias("label"))
    s4w = f.alias("f").crossJoin(F.broadcast(g.alias("g"))).select(  # three rows a side
        (F.col("f.ord") * 3 + F.col("g.ord") + 1).alias("config_ord"), F.concat(F.lit("S4W_"), "f.key", F.lit("_"), "g.key").alias("config_id"),
        F.lit("S4W").alias("family"), F.create_map(F.lit("facade"), pick("f"), F.lit("glass"), pick("g")).alias("groups"))
    named = lambda c: F.struct(F.lit(None).cast("double").alias("eps"), F.lit(None).cast("double").alias("sigma"), c.alias("label"))
    s5 = spark.createDataFrame([(i + 10, l) for i, l in enumerate(labels)], "config_ord int, l string").select(
        "config_ord", F.concat(F.lit("S5_"), "l", F.lit("_glass")).alias("config_id"), F.lit("S5").alias("family"),
        F.create_map(F.lit("facade"), named(F.col("l")), F.lit("glass"), named(F.lit("glass"))).alias("groups"))
    base = spark.range(1).select(F.lit(0).alias("config_ord"), F.lit("AUTO_BASE").alias("config_id"), F.lit("BASE").alias("family"),
                                 F.expr(f"cast(map() as map<string,{value}>)").alias("groups"))
    return base.unionByName(s4w).unionByName(s5)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``{id, family, groups}``; group values are {eps, sigma} or a label."""
    raw = spark.read.schema("id string, family string, groups map<string,string>").option("multiLine", True).json(path)
    entry = F.transform_values("groups", lambda k, v: F.when(
        v.startswith("{"), F.from_json(v, "eps double, sigma double, label string")).otherwise(
        F.struct(F.lit(None).cast("double").alias("eps"), F.lit(None).cast("double").alias("sigma"), v.alias("label"))))
    return raw.select(F.col("id").alias("config_id"), "family", entry.alias("groups"))


def read_annotations(spark: SparkSession, path: str, face_count: int | None = None) -> DataFrame:
    """``{"face_labels": {face: label | {category, confidence}}}`` -> (face_id, category, confidence)."""
    doc = spark.read.schema("face_labels map<string,string>").option("multiLine", True).json(path)
    return explode_annotations(doc, face_count)


def explode_annotations(doc: DataFrame, face_count: int | None = None) -> DataFrame:
    rows = doc.select(F.explode("face_labels").alias("_k", "_v"))
    item = F.from_json("_v", "category string, confidence double")
    rich = F.col("_v").startswith("{")
    face = F.col("_k").cast("bigint")
    limit = (face < 0) | (face >= face_count) if face_count is not None else face < 0
    category = F.when(limit | face.isNull(), F.raise_error(F.concat(F.lit("annotation face id out of range: "), "_k"))).when(
        rich & (F.coalesce(item["category"], F.lit("")) == ""), F.raise_error(F.concat(F.lit("invalid face annotation for "), "_k"))).when(
        rich, item["category"]).otherwise(F.col("_v"))
    return rows.select(face.alias("face_id"), category.alias("category"),
                       F.when(rich, F.coalesce(item["confidence"], F.lit(1.0))).otherwise(1.0).alias("confidence"))


def synthetic_points(spark: SparkSession, n: int, train_n: int, seed: int = 42, extent: float = 300.0) -> DataFrame:
    """Software-test data: hashed positions, log-distance gain, a sine field and small noise."""
    u = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    tx = (extent / 2, extent / 2, 30.0)
    t = spark.range(n).select("id", (u("x") * extent).alias("x"), (u("y") * extent).alias("y"), F.lit(1.5).alias("z"), u("a").alias("_a"), u("b").alias("_b"))
    dist = F.sqrt(F.pow(F.col("x") - tx[0], 2) + F.pow(F.col("y") - tx[1], 2) + F.pow(F.col("z") - tx[2], 2))
    noise = F.sqrt(-2.0 * F.log(F.greatest("_a", F.lit(1e-12)))) * F.cos(2 * math.pi * F.col("_b"))
    t = t.withColumn("d3", dist).withColumn("raw", -30.0 - 20.0 * F.log10("d3"))
    return t.select(
        F.format_string("synthetic-%04d", "id").alias("point_id"), "x", "y", "z", F.lit("n41").alias("band"),
        F.when(F.col("id") < train_n, "train").otherwise("query").alias("role"),
        (F.col("raw") + 4.0 * F.sin(F.col("x") / 70.0) + noise).alias("truth_dbm"), "raw", (F.col("x") > 100).alias("los"), "d3"
    ).withColumn("observed_dbm", F.when(F.col("role") == "train", F.col("truth_dbm")))


def plan_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, r, g, b) of the image tiles under ``path``; tiles are named …_<row0>_<col0>.<ext>.

    The image source decodes one tile per row; its BGR bytes become pixel rows on the executors.
    """
    tiles = spark.read.format("image").load(path).select("image.*")
    at = lambda i: F.coalesce(F.expr(f"try_cast(regexp_extract(origin, '_([0-9]+)_([0-9]+)[.][A-Za-z]+$', {i}) as bigint)"), F.lit(0))
    byte = lambda k: F.conv(F.hex(F.substring("data", (F.col("_p") * F.col("nChannels") + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = tiles.filter("nChannels >= 3").select(
        at(1).alias("_r0"), at(2).alias("_c0"), "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_p"))
    return px.select((F.col("_r0") + F.floor(F.col("_p") / F.col("width"))).alias("row"), (F.col("_c0") + F.col("_p") % F.col("width")).alias("col"),
                     byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def plan_mask(pixels: DataFrame, lower=(160, 120, 70), upper=(245, 220, 190), r_minus_g: int = 10, g_minus_b: int = 10,
              crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Building-fill pixels: strictly inside the colour box, channel gaps exceeded, inside the crop."""
    keep = (F.col("r") - F.col("g") > r_minus_g) & (F.col("g") - F.col("b") > g_minus_b)
    for c, lo, hi in zip("rgb", lower, upper):
        keep = keep & (F.col(c) > lo) & (F.col(c) < hi)
    if crop is not None:
        left, top, right, bottom = crop
        keep = keep & (F.col("col") >= left) & (F.col("col") < right) & (F.col("row") >= top) & (F.col("row") < bottom)
    return pixels.filter(keep).select("row", "col")


# --- sinks ----------------------------------------------------------------------------------------

def write_result(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Refuses an existing target; gzip CSV on request."""
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("compression", "gzip").csv(path)
    else:
        w.format(fmt).save(path)


def manifest(spark: SparkSession, scene_id: str, version: str, inputs: dict[str, str], outputs: dict[str, str], schema: str) -> DataFrame:
    """One row whose JSON lists inputs and outputs in key order."""
    ordered = lambda d: F.create_map(*[F.lit(v) for k in sorted(d) for v in (k, d[k])]) if d else F.expr("cast(map() as map<string,string>)")
    return spark.range(1).select(F.lit(schema).alias("schema"), F.lit(scene_id).alias("scene_id"), F.lit(version).alias("version"),
                                 ordered(inputs).alias("inputs"), ordered(outputs).alias("outputs"))


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("errorifexists").json(path)  # one row


def report(stages: DataFrame) -> DataFrame:
    """Status and distinct review reasons of a run from ``stages(stage_ord, stage, reasons ARRAY)``."""
    r = stages.select("stage_ord", F.posexplode_outer("reasons").alias("_p", "_r"))
    first = r.filter("_r is not null and _r <> ''").groupBy("_r").agg(F.min(F.struct("stage_ord", "_p")).alias("_at"))
    reasons = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_r"))), lambda s: s["_r"]).alias("review_reasons"))  # reason codes
    names = stages.agg(F.transform(F.array_sort(F.collect_list(F.struct("stage_ord", "stage"))), lambda s: s["stage"]).alias("completed_stages"))
    both = names.crossJoin(F.broadcast(reasons))  # one row each
    return both.withColumn("status", F.when(F.size("review_reasons") == 0, "PASS_AUTOMATED_PRIOR").otherwise("REVIEW_REQUIRED"))


def write_face_labels(df: DataFrame, path: str, label: str) -> None:
    df.select("face_id", label).sort("face_id").write.mode("errorifexists").option("header", True).csv(path)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)
