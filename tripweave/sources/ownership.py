"""Cell ownership and group master tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.geohash import METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON_EQUATOR
from tripweave.operators.flows import UNASSIGNED
from tripweave.operators.ranking import exact_quantiles


def read_tables(spark: SparkSession, ownership_path: str, master_path: str) -> tuple[DataFrame, DataFrame]:
    """Read both tables (CSV with a header, or Parquet) and refuse repeated or unknown keys."""

    def read(path: str) -> DataFrame:
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        return spark.read.option("header", True).csv(path)

    ownership = read(ownership_path).withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})
    master = read(master_path).withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})
    check_keys(ownership, master)
    return ownership, master


def check_keys(ownership: DataFrame, master: DataFrame) -> None:
    """Cells and groups must be unique, and every owned cell must name a known group."""
    for df, key in ((ownership, "geohash"), (master, "gp")):
        repeated = df.groupBy(key).count().where("count > 1").take(3)
        if repeated:
            raise ValueError(f"{key} repeats: {[r[key] for r in repeated]}")
    owned = ownership.where(F.col("gp") != UNASSIGNED).select("gp").distinct()
    unknown = owned.join(master, "gp", "left_anti").take(3)
    if unknown:
        raise ValueError(f"groups without a master row: {[r['gp'] for r in unknown]}")


def with_centroids(master: DataFrame, ownership: DataFrame) -> DataFrame:
    """Fill missing group centres with the mean of the group's cells, and count the cells."""
    cells = ownership.where(F.col("gp") != UNASSIGNED).groupBy("gp").agg(
        F.count("*").alias("n_cells"), F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon")
    )
    joined = master.drop("n_cells").join(cells, "gp", "left")
    return joined.withColumns({"lat": F.coalesce("lat", "_lat"), "lon": F.coalesce("lon", "_lon")}).drop("_lat", "_lon")


def group_bounds(ownership: DataFrame) -> DataFrame:
    """Extent of each group's cells."""
    return ownership.where(F.col("gp") != UNASSIGNED).groupBy("gp").agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")
    )


def centre_distances(ownership: DataFrame, master: DataFrame, limit_m: float = 350.0) -> DataFrame:
    """Distance from each owned cell to its group's centre: a large one means mixed datums."""
    joined = ownership.where(F.col("gp") != UNASSIGNED).join(
        master.select("gp", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "gp"
    )
    north = (F.col("lat") - F.col("_lat")) * METRES_PER_DEGREE_LAT
    east = (F.col("lon") - F.col("_lon")) * METRES_PER_DEGREE_LON_EQUATOR * F.cos(F.radians("_lat"))
    apart = joined.select(F.sqrt(north * north + east * east).alias("metres"))
    sizes = apart.agg(
        F.count("*").alias("cells"), F.max("metres").alias("max_m"), F.count_if(F.col("metres") > limit_m).alias("beyond")
    ).withColumn("_one", F.lit(1))
    quantiles = exact_quantiles(apart, "metres", {"median_m": 0.5, "p99_m": 0.99}).withColumn("_one", F.lit(1))
    # Two one-row frames.
    return sizes.join(F.broadcast(quantiles), "_one").drop("_one")
