"""Detectors under one contract: fit on built sequences, predict all of them, and say what was learnt.

A detector is made from settings (a dict, as of a TOML file) by the factory of its name. `fit` learns from the training part and gives
a fitted detector: `predict` adds score and predicted_label (and abstained, where it may abstain) to the sequences, `manifest` is
what a run writes about the model, `metrics` what it measures beyond the confusion counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.bayes import BERNOULLI, COMPLEMENT, MULTINOMIAL, NaiveBayes
from seqloom.operators.clusters import ClusteredContexts
from seqloom.operators.contexts import ContextModel
from seqloom.operators.frequency import TemplateFrequency
from seqloom.operators.metrics import FULL_DATASET, decision_summary, next_event_metrics
from seqloom.operators.next_event import KeyModel, ParameterModel, predict_jointly
from seqloom.operators.representations import phrase_counts
from seqloom.operators.sequences import Sequences
from seqloom.schemas import TEST
from seqloom.storage import kept


class FittedDetector(Protocol):
    def predict(self, built: Sequences) -> DataFrame: ...

    def manifest(self) -> dict: ...

    def metrics(self, built: Sequences) -> dict: ...


class Detector(Protocol):
    def fit(self, built: Sequences) -> FittedDetector: ...


@dataclass(frozen=True)
class FrequencyDetector:
    config: TemplateFrequency

    def fit(self, built: Sequences) -> FittedFrequency:
        return FittedFrequency(self.config.fit(built.members, built.sequences))


@dataclass(frozen=True)
class FittedFrequency:
    model: object

    def predict(self, built: Sequences) -> DataFrame:
        return self.model.predict(built.members, built.sequences)

    def manifest(self) -> dict:
        return {"threshold": self.model.threshold, "smoothing": self.model.smoothing, "train_events": self.model.total, "vocabulary": self.model.vocabulary}

    def metrics(self, built: Sequences) -> dict:
        return {}


@dataclass(frozen=True)
class PhraseDetector:
    config: NaiveBayes
    low: int = 1
    high: int = 2

    def features(self, built: Sequences) -> DataFrame:
        return kept(phrase_counts(built.members, self.low, self.high))

    def fit(self, built: Sequences) -> FittedPhrases:
        features = self.features(built)
        return FittedPhrases(self, self.config.fit(features, built.sequences), built, features)


@dataclass(frozen=True)
class FittedPhrases:
    detector: PhraseDetector
    model: object
    seen: Sequences
    features: DataFrame

    def predict(self, built: Sequences) -> DataFrame:
        features = self.features if built is self.seen else self.detector.features(built)
        return self.model.predict(features, built.sequences)

    def manifest(self) -> dict:
        top = {str(label): [r["feature"] for r in self.model.global_phrases(label).collect()] for label in (0, 1)}  # top_k rows each
        return {"form": self.model.config.form, "smoothing": self.model.config.smoothing, **self.model.totals, "top_phrases": top}

    def metrics(self, built: Sequences) -> dict:
        return {}


def entity_local(built: Sequences, name: str) -> None:
    """An error if a sequence has rows of several entities."""
    mixed = built.members.groupBy("window_id").agg(F.min("entity_id").alias("a"), F.max("entity_id").alias("b")).where("a <> b")
    if not mixed.isEmpty():
        raise ValueError(f"{name} needs sequences of one entity each")


@dataclass(frozen=True)
class JointDetector:
    """Next-event keys, and parameters where the key passed. mixed: whether sequences of several entities are taken."""

    keys: KeyModel
    parameters: ParameterModel
    mixed: bool = False
    policy: str = FULL_DATASET

    def fit(self, built: Sequences) -> FittedJoint:
        if not self.mixed:
            entity_local(built, "next_event")
        return FittedJoint(self, self.keys.fit(built.members, built.sequences), self.parameters.fit(built.members, built.sequences))


@dataclass(frozen=True)
class FittedJoint:
    detector: JointDetector
    keys: object
    parameters: object

    def predict(self, built: Sequences) -> DataFrame:
        if not self.detector.mixed:
            entity_local(built, "next_event")
        return predict_jointly(self.keys, self.parameters, built.members, built.sequences)

    def manifest(self) -> dict:
        keys, parameters = self.detector.keys, self.detector.parameters
        modelled = self.parameters.bounds.where("upper IS NOT NULL")
        return {
            "history_size": keys.history,
            "top_g": keys.top,
            "vocabulary": self.keys.vocabulary.count(),
            "histories": self.keys.ranked.select("ending").distinct().count(),
            "parameter_history_size": parameters.history,
            "parameter_confidence": parameters.confidence,
            "parameter_templates": modelled.count(),
            "parameter_features": self.parameters.scale.count(),
        }

    def metrics(self, built: Sequences) -> dict:
        """Next-event metrics over test sequences, by the detector's vocabulary policy."""
        test = built.members.join(built.sequences.where(F.col("split_label") == TEST).select("window_id"), "window_id", "left_semi")
        events = kept(self.keys.events(test).select(F.col("target").alias("actual"), "candidates", "history"))
        early = test.where(F.col("pos") < self.detector.keys.history).count()
        found = next_event_metrics(events, known=self.keys.vocabulary, policy=self.detector.policy, insufficient=early)
        return {"next_event": found["topk"].first().asDict() | found["summary"].first().asDict()}


@dataclass(frozen=True)
class ContextDetector:
    config: ContextModel | ClusteredContexts

    def fit(self, built: Sequences) -> FittedContexts:
        return FittedContexts(self.config.fit(built.members, built.sequences))


@dataclass(frozen=True)
class FittedContexts:
    model: object

    def predict(self, built: Sequences) -> DataFrame:
        return self.model.predict(built.members, built.sequences)

    def manifest(self) -> dict:
        sizes = self.model.groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n") >= self.model.config.min_samples).alias("confident_groups"), F.sum("n").alias("train_events"), F.count_distinct("template").alias("vocabulary"))
        return {"context_length": self.model.config.size, "timeout_ms": self.model.config.timeout_ms, "min_samples": self.model.config.min_samples} | sizes.first().asDict()

    def metrics(self, built: Sequences) -> dict:
        return {"decisions": decision_summary(self.model.events(built.members, built.sequences).where(F.col("split_label") == TEST)).first().asDict()}


def phrase_detector(form: str) -> Callable[[dict], Detector]:
    return lambda m: PhraseDetector(NaiveBayes(form, m.get("smoothing", 1.0), m.get("top_k_phrases", 5), m.get("anomalous_posterior_threshold", 0.5)), m.get("phrase_ngram_min", 1), m.get("phrase_ngram_max", 2))


#: Detector name -> settings -> detector; further ones are added by `register`.
DETECTORS: dict[str, Callable[[dict], Detector]] = {
    "template_frequency": lambda m: FrequencyDetector(TemplateFrequency(m.get("smoothing", 1.0), m.get("score_threshold_quantile", 0.95), m.get("score_threshold"))),
    "naive_bayes": phrase_detector(MULTINOMIAL),
    "bernoulli_nb": phrase_detector(BERNOULLI),
    "complement_nb": phrase_detector(COMPLEMENT),
    "next_event": lambda m: JointDetector(KeyModel(m.get("history_size", 10), m.get("top_g", 9), strict=True), ParameterModel(m.get("parameter_history_size", m.get("history_size", 10)), m.get("validation_fraction", 0.3), m.get("confidence", 0.98)), m.get("mixed_entities", False), m.get("vocabulary_policy", FULL_DATASET)),
    "context": lambda m: ContextDetector(ContextModel(m.get("context_length", 10), int(m.get("timeout_seconds", 86_400) * 1000), m.get("min_samples", 5))),
    "context_clusters": lambda m: ContextDetector(ClusteredContexts(m.get("context_length", 10), int(m.get("timeout_seconds", 86_400) * 1000), m.get("min_samples", 5), m.get("eps", 0.1))),
}


def register(name: str, factory: Callable[[dict], Detector]) -> None:
    """Adds a detector of one's own under a new name."""
    if name in DETECTORS:
        raise ValueError(f"there is a detector {name!r} already")
    DETECTORS[name] = factory


def detector(settings: dict) -> Detector:
    """The detector that settings name under `detector`."""
    name = settings.get("detector")
    if name not in DETECTORS:
        raise KeyError(f"unknown detector {name!r}; known: {', '.join(sorted(DETECTORS))}")
    return DETECTORS[name](settings)
