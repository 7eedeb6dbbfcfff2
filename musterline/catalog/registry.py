"""Queries on the given tables by inventory name, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from musterline.catalog.inputs import Given, with_views
from musterline.cluster import ship_package, small_enough
from musterline.functions.geometry import box

Query = Callable[[Given], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; ``check`` follows the common table expressions of ``views``."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = (with_views(*views) if views else "") + check.strip()
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM never compiles a method above this size; Spark then runs the step by smaller ones.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    ship_package()
    return QUERIES[name](Given(spark, folder))


def detections(given: Given) -> DataFrame:
    """The detections view with its box and landmarks nested."""
    flat = given.view("detections", spread=True)

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    left = point(F.col("left_x"), F.col("left_y"))
    right = point(F.col("right_x"), F.col("right_y"))
    nose = point(F.col("nose_x"), F.col("nose_y"))
    mouth = [point(F.col(x), F.col("nose_y") + 20) for x in ("left_x", "right_x")]
    landmarks = F.when(F.col("has_landmarks"), F.array(left, right, nose, *mouth))
    edges = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    nested = flat.withColumn("box", box(*edges)).withColumn("landmarks", landmarks)
    loose = ["x1", "y1", "x2", "y2", "has_landmarks", "left_x", "left_y", "right_x", "right_y", "nose_x", "nose_y"]
    return nested.drop(*loose)


def with_faces(detections: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Detections with a vector: a person's own one of all given vectors, tinged with another.

    Vectors are numbered from 0 on, and the numbers of detections run through all of them. Few vectors are sent to the
    detections, which then stay where they are."""
    vectors = embeddings.agg(F.count(F.lit(1))).scalar()
    own, other = F.pmod(F.col("user_id") * 7, vectors), F.pmod(F.col("det_idx"), vectors)
    if small_enough(embeddings):
        embeddings = F.broadcast(embeddings)
    mine = embeddings.select(F.col("vec_id").alias("_own"), F.col("embedding").alias("_mine"))
    tinge = embeddings.select(F.col("vec_id").alias("_other"), F.col("embedding").alias("_tinge"))
    weight = (F.col("det_idx") % 9) / 6
    mixed = F.zip_with("_mine", "_tinge", lambda x, y: (x + y * F.col("_weight")).cast("float"))
    joined = detections.withColumns({"_own": own, "_other": other, "_weight": weight})
    joined = joined.join(mine, "_own").join(tinge, "_other")
    return joined.withColumn("embedding", mixed).drop("_own", "_other", "_mine", "_tinge", "_weight")


def cameras(given: Given) -> DataFrame:
    """The cameras view with its region as an array; a camera without one has null."""
    view = given.view("cameras")
    roi = F.array(F.lit(0.0), F.lit(0.1), F.col("roi_x2"), F.lit(0.7))
    return view.withColumn("roi", F.when(F.col("roi_x2").isNotNull(), roi)).drop("roi_x2")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})
