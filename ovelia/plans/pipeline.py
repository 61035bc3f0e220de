"""Load, resample, evaluate, choose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.stages import cut
from ..operators import samplers as sm
from ..operators.evaluate import ModelEvaluator
from ..operators.samplers import overlap_region
from ..sources import labelled

TECHNIQUES = {
    "ROS": sm.RandomOverSampler, "RUS": sm.RandomUnderSampler, "NUS": sm.NUS, "URNS": sm.URNS,
    "NB-Basic": lambda: sm.NBUS("basic"), "NB-Tomek": lambda: sm.NBUS("tomek"), "NB-Comm": lambda: sm.NBUS("common"), "NB-Rec": lambda: sm.NBUS("recursive"),
    "HKM": lambda: sm.KMeansUndersampling("HKM"), "FCM": lambda: sm.KMeansUndersampling("FCM"), "RKM": lambda: sm.KMeansUndersampling("RKM"), "FRKM": lambda: sm.KMeansUndersampling("FRKM"),
    "RFCL": sm.RFCL, "SVDDWSMOTE": sm.SVDDWSMOTE, "ODBOT": sm.ODBOT, "EHSO": sm.EHSO, "FCMBoostOBU": sm.FCMBoostOBU, "DeviOCSVM": sm.DeviOCSVM, "OSM": sm.OSM,
    "SMOTE": sm.SMOTE, "BLSMOTE1": sm.BorderlineSMOTE,
}


class ImbalancedPipeline:
    """Steps must be called in order; a step out of order is a ValueError."""

    def __init__(self, spark: SparkSession, seed: int = 42, leakage: str = "none"):
        self.spark, self.seed = spark, seed
        self.evaluator = ModelEvaluator(seed=seed, leakage=leakage)
        self.data: DataFrame | None = None
        self.samplers: dict = {}
        self.resampled_: dict[str, DataFrame] = {}

    def load_data(self, source: str = "synthetic", **options) -> DataFrame:
        if source == "synthetic":
            df = labelled.synthetic(self.spark, **options)
            df = labelled.standard_scaler(df).transform(df)
        elif source == "dataframe":
            df, self.fitted_ = labelled.from_dataframe(**options)
        elif source == "csv":
            df, self.fitted_ = labelled.read_csv(self.spark, **options)
        else:
            raise ValueError("source must be synthetic, dataframe or csv")
        self.data = cut(df)
        return self.data

    def _loaded(self) -> DataFrame:
        if self.data is None:
            raise ValueError("load data first")
        return self.data

    def statistics(self) -> DataFrame:
        return labelled.class_distribution(self._loaded())

    def overlap(self, k: int = 5) -> DataFrame:
        return overlap_region(self._loaded(), k)

    def apply_resampling_techniques(self, techniques: dict | None = None) -> dict[str, DataFrame]:
        df = self._loaded()
        self.samplers = techniques or {n: TECHNIQUES[n]() for n in ("EHSO", "ROS", "RUS")}
        self.resampled_ = {n: cut(s.resample(df)) for n, s in self.samplers.items()}
        return self.resampled_

    def evaluate_techniques(self, classifier: str = "random_forest") -> DataFrame:
        if not self.resampled_:
            raise ValueError("resample first")
        return self.evaluator.compare(self._loaded(), self.samplers, classifier)

    def get_best_technique(self, metric: str = "g_mean") -> str:
        return self.evaluator.best(metric)

    def run_complete_pipeline(self, source: str = "synthetic", techniques: dict | None = None, classifier: str = "random_forest", **options) -> dict:
        self.load_data(source, **options)
        self.apply_resampling_techniques(techniques)
        results = self.evaluate_techniques(classifier)
        return {"data_stats": self.statistics(), "evaluation_results": results, "best_technique": self.get_best_technique(), "resampled_data": self.resampled_}
