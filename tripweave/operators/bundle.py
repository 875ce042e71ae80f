"""A fitted model with its feature state: saved as one folder, reloaded, applied to bare keys."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripweave.functions.clock import Horizon
from tripweave.operators.boosting import CountTrees
from tripweave.operators.features import FeatureSet
from tripweave.operators.models import boosted_columns


class Bundle:
    """Model, fitted blocks, column order, calibration factor, the horizon its slots count in, and notes.

    A slot number means a time of day only within a horizon: a bundle is saved with it, and loading it for another one, or predicting
    slots beyond it, is refused. Predicting needs the key columns, and lat and lon where a block asks for them. The window of the calendar starts at
    `first_day`, the first training date, whatever days are predicted; a bundle without one is not saved.
    """

    def __init__(self, model: CountTrees, features: FeatureSet, horizon: Horizon, factor: float = 1.0, meta: dict | None = None, first_day: date | None = None):
        self.model, self.features, self.horizon, self.factor = model, features, horizon, float(factor)
        self.meta = dict(meta or {})
        for block in features.blocks:
            if first_day is not None and getattr(block, "origin", first_day) is None:
                block.origin = first_day

    def predict(self, keys: DataFrame) -> DataFrame:
        columns = self.features.columns
        lacking = [c for b in self.features.blocks for c in b.requires if c not in keys.columns]
        if lacking:
            raise ValueError(f"the model needs {lacking}")
        known = [c for c in ("block_id", "date", "slot", "lat", "lon") if c in keys.columns]
        beyond = keys.where((F.col("slot") < 0) | (F.col("slot") >= self.horizon.n_slots)).select("slot").take(1)
        if beyond:
            raise ValueError(f"slot {beyond[0]['slot']} is outside the {self.horizon.n_slots} slots of the model's horizon")
        made = boosted_columns(self.features.transform(keys.select(*known)), columns)
        scored = self.model.transform(made)
        return scored.select(
            "block_id", "date", "slot", F.col("pred").alias("pred_raw"), (F.col("pred") * self.factor).alias("pred")
        )

    def save(self, path: str) -> None:
        """Write the model, one Parquet table per learnt table, and a JSON description."""
        if any(getattr(block, "origin", 0) is None for block in self.features.blocks):
            raise ValueError("the calendar's window has no first day")
        self.model.stages.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        described: dict = {"factor": self.factor, "intercept": self.model.intercept, "horizon": asdict(self.horizon), "meta": self.meta, "columns": self.features.columns, "blocks": {}}
        for block in self.features.blocks:
            plain, tables = {}, {}
            for key, value in block.state().items():
                if isinstance(value, DataFrame):
                    table = f"state/{block.name}_{key}"
                    value.write.mode("overwrite").parquet(f"{path}/{table}")
                    tables[key] = {"table": table, "fingerprint": fingerprint(spark.read.parquet(f"{path}/{table}"))}
                else:
                    plain[key] = {"date": value.isoformat()} if isinstance(value, date) else value
            described["blocks"][block.name] = {"plain": plain, "tables": tables}
        text = json.dumps(described)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")

    @classmethod
    def load(cls, spark: SparkSession, path: str, blocks: list, horizon: Horizon) -> "Bundle":
        """Read a folder back into freshly made blocks; refuses other blocks, another horizon or changed tables."""
        described = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
        if "horizon" not in described:
            raise ValueError(f"{path} does not say which horizon its slots count in; save it again")
        if Horizon(**described["horizon"]) != horizon:
            raise ValueError(f"saved for {described['horizon']}, not {asdict(horizon)}")
        names = [b.name for b in blocks]
        if names != list(described["blocks"]):
            raise ValueError(f"saved with blocks {list(described['blocks'])}, not {names}")
        for block in blocks:
            saved = described["blocks"][block.name]
            state = {
                k: date.fromisoformat(v["date"]) if isinstance(v, dict) and set(v) == {"date"} else v
                for k, v in saved["plain"].items()
            }
            for key, entry in saved["tables"].items():
                table = spark.read.parquet(f"{path}/{entry['table']}")
                if fingerprint(table) != entry["fingerprint"]:
                    raise ValueError(f"{entry['table']} is not the table that was saved")
                state[key] = table
            block.load(state)
        features = FeatureSet(blocks)
        if features.columns != described["columns"]:
            raise ValueError("the blocks emit other columns than the saved ones")
        model = CountTrees(PipelineModel.load(f"{path}/model"), described["intercept"])
        return cls(model, features, horizon, described["factor"], described["meta"])


def fingerprint(table: DataFrame) -> str:
    """Order-free checksum of a table: row count and sum of row hashes."""
    columns = sorted(table.columns)
    row = table.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"


def largest_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How far two prediction tables are apart, over all keys of either."""
    joined = left.select(*keys, F.col("pred").alias("a")).join(right.select(*keys, F.col("pred").alias("b")), keys, "full")
    return joined.agg(
        F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"),
    )
