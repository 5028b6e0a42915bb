"""Fit on labeled awards, score others, save and load."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import by_score
from ..operators.embed import TEXT_SIZE, hashing_embedding
from ..operators.encoding import CategorySlots
from ..operators.forest import MAX_SAMPLES, ForestArrays, IsolationForestModel
from ..operators.fusion import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS, FusionModel
from ..operators.filters import department as by_department
from ..operators.joins import distinct_ids
from ..operators.scores import SUMMARY
from ..session import checkpoint, measure, store
from ..sinks import write_predictions, write_records, write_review
from ..sources import read_awards, read_labeled, rejected_awards, sampled
from .prepare import prepare_labeled, prepare_unlabeled

log = logging.getLogger(__name__)
Embed = Callable[[DataFrame], DataFrame]
SCALER = "position int, column string, mean double, std double"
PARAMS = f"samples int, offset double, threshold double, text_size int, share double, {SUMMARY}"
CATEGORIES = "position int, column string, category string, slot int"


@dataclass
class AwardModel:
    """A fitted model: fused features, forest and the ids it was fitted on."""

    fusion: FusionModel
    forest: IsolationForestModel
    labeled_ids: DataFrame
    ids_size: tuple[int, int]
    embed: Embed
    text_size: int

    @classmethod
    def fit(
        cls, labeled: DataFrame, embed: Embed | None = None, text_size: int = TEXT_SIZE, n_estimators: int = 100,
        max_samples: int = MAX_SAMPLES, contamination: float = 0.1, seed: int = 42, share: float = 0.2,
    ) -> AwardModel:
        """Learn from labeled awards. ``embed`` adds ``text_vector``; default is the hashing encoder."""
        embed = embed or (lambda df: hashing_embedding(df, size=text_size))
        # Only the columns the features need; stored once, read by every statistic below.
        prepared = prepare_labeled(labeled)
        wanted = [c for c in ("piid", "clean_description", *NUMERIC_COLUMNS, *CATEGORICAL_COLUMNS) if c in prepared.columns]
        stored = store(prepared.select(*wanted))
        fusion = FusionModel.fit(stored, share)
        features = fusion.transform(embed(stored), wrap=False)
        forest = IsolationForestModel.fit(
            features, n_estimators=n_estimators, max_samples=max_samples, contamination=contamination, seed=seed
        )
        ids = distinct_ids(stored) if "piid" in stored.columns else labeled.sparkSession.createDataFrame([], "piid string")
        ids = checkpoint(ids)
        return cls(fusion, forest, ids, measure(ids), embed, text_size)

    def features(self, prepared: DataFrame, wrap: bool = True) -> DataFrame:
        """Add the fused vector, or its bare struct without ``wrap``, which needs no Python worker."""
        return self.fusion.transform(self.embed(prepared), wrap=wrap)

    def score(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """Unlabeled awards with score and flags, in no order: a map over the rows apart from joins with
        small tables, so it also takes a streaming DataFrame."""
        prepared = prepare_unlabeled(df, self.labeled_ids, self.ids_size)
        scored = self.forest.score(self.fusion.transform(self.embed(prepared), wrap=False))
        return self.forest.flags(scored.drop("features", "text_vector"), threshold)

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """``score`` sorted by falling score.

        A global sort reads its input twice, to find the ranges and to sort, so the scores are stored first.
        """
        return by_score(store(self.score(df, threshold)), stored=True)

    def feature_names(self, spark: SparkSession) -> DataFrame:
        return self.fusion.feature_names(spark, self.text_size)


def run(
    spark: SparkSession, labeled_path: str, unlabeled_paths: str | list[str], out: str, threshold: float | None = None,
    sample_size: int | None = None, save: bool = True, department: str | None = None, load_from: str | None = None, embed: Embed | None = None, **settings,
) -> DataFrame:
    """Load a model or fit one on a labeled file and save it, score award files, write all results and those for review.

    ``load_from`` is a folder that ``save_model`` wrote; if it holds no model, one is fitted. ``department`` keeps the awards of
    agencies with that text in their name. JSON lines and files of the unlabeled awards that are no JSON are in
    ``<out>/rejected_json``.
    """
    model = None
    if load_from:
        try:
            model = load_model(spark, load_from, embed)
        except (AnalysisException, ValueError) as error:
            log.warning("no model in %s, fitting one: %s", load_from, error)
    if model is None:
        model = AwardModel.fit(read_labeled(spark, labeled_path), embed, **settings)
        if save:
            save_model(model, f"{out}/model")
    awards = read_awards(spark, unlabeled_paths)
    write_records(rejected_awards(spark, unlabeled_paths), f"{out}/rejected_json")
    awards = awards if department is None else by_department(awards, department)
    scored = model.predict(awards if sample_size is None else sampled(awards, sample_size), threshold)
    folder = write_predictions(scored, out)
    write_review(scored, out)
    return by_score(spark.read.parquet(folder))


def save_model(model: AwardModel, path: str) -> None:
    """Write the model as small Parquet tables under ``path``."""
    spark = model.forest.nodes.sparkSession
    model.forest.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    summary = None if model.forest.summary is None else model.forest.summary.select("n", "low", "high", "sketch").first()
    params = [(model.forest.samples, model.forest.offset, model.forest.threshold, model.text_size, model.fusion.share, *(summary or [None] * 4))]
    spark.createDataFrame(params, PARAMS).write.mode("overwrite").parquet(f"{path}/params")
    numeric = [(i, *row) for i, row in enumerate(model.fusion.numeric)]
    spark.createDataFrame(numeric, SCALER).write.mode("overwrite").parquet(f"{path}/scaler")
    categories = spark.createDataFrame([], CATEGORIES)
    for i, part in enumerate(model.fusion.categories):
        categories = categories.union(part.table.select(
            F.lit(i).alias("position"), F.lit(part.column).alias("column"), "category", F.col("slot").cast("int").alias("slot")
        ))
    categories.write.mode("overwrite").parquet(f"{path}/categories")
    model.labeled_ids.write.mode("overwrite").parquet(f"{path}/labeled_ids")


def _table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(kind).parquet(path)
    except AnalysisException:
        log.warning("no %s, continuing without it", path)
        return spark.createDataFrame([], kind)


def load_model(spark: SparkSession, path: str, embed: Embed | None = None) -> AwardModel:
    """Read a saved model. Raises without a forest; other missing parts are empty."""
    nodes = spark.read.parquet(f"{path}/forest")
    stored = _table(spark, f"{path}/params", PARAMS)
    params = stored.first()
    if params is None:
        raise ValueError(f"no parameters in {path}")
    fusion = FusionModel(share=params["share"])
    scaler = _table(spark, f"{path}/scaler", SCALER).orderBy("position").collect()
    fusion.numeric = [(r["column"], r["mean"], r["std"]) for r in scaler]
    categories = _table(spark, f"{path}/categories", CATEGORIES)
    for row in categories.select("position", "column").distinct().orderBy("position").collect():
        part = categories.where(F.col("position") == row["position"]).select("category", "slot")
        fusion.categories.append(CategorySlots.stored(row["column"], part))
    forest = IsolationForestModel(nodes, params["samples"], params["offset"], params["threshold"], ForestArrays.collect(nodes),
                                 stored.select("n", "low", "high", "sketch").where("n IS NOT NULL"))
    ids = _table(spark, f"{path}/labeled_ids", "piid string")
    size = params["text_size"]
    return AwardModel(fusion, forest, ids, measure(ids), embed or (lambda df: hashing_embedding(df, size=size)), size)
