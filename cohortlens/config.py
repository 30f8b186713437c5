"""Study settings: label names, thresholds, ensembles and hyper-parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values of the study.
# ---------------------------------------------------------------------------

TASKS = ("ia", "ps")
MODELS = ("lr", "rf", "gbm", "mlp")
METRICS = ("sensitivity", "specificity", "ppv", "auroc", "npv", "f1")

METRIC_DEFINITIONS = {
    "sensitivity": "When it's ACTUALLY YES, how often does it PREDICT YES?",
    "specificity": "When it's ACTUALLY NO, how often does it PREDICT NO?",
    "ppv": "When it PREDICTS YES, how often is it correct?",
    "auroc": "Indicates how well the model is capable of distinguishing between classes",
    "npv": "When it PREDICTS NO, how often is it correct?",
    "f1": "Harmonic mean of sensitivity and ppv",
}

LABEL_COLUMN = {"ia": "imminent_adm_label", "ps": "prolonged_stay_label"}

LABEL_NAMES = {
    "imminent_adm_label": {-1: "Unused", 0: "Delayed Admission", 1: "Imminent Admission"},
    "prolonged_stay_label": {0: "Short Stay", 1: "Prolonged Stay"},
}

# Days before intensive care, bucket 0 to 15.
INTERVAL_NAMES = (
    ["-1 ≤ t ≤ 0"] + [f"-{i + 1} ≤ t ≤ -{i}" for i in range(1, 15)] + ["t ≤ -15"]
)

# Operating thresholds of the ensemble analysis.
THRESHOLDS = {
    "ia": {"lr": 0.45, "rf": 0.27, "gbm": 0.435, "mlp": 0.2},
    "ps": {"lr": 0.39, "rf": 0.36, "gbm": 0.324, "mlp": 0.27},
}

# Operating thresholds of the training runs.
TRAINING_THRESHOLDS = {
    "ia": {"lr": 0.45, "rf": 0.27, "gbm": 0.42, "mlp": 0.2},
    "ps": {"lr": 0.41, "rf": 0.37, "gbm": 0.34, "mlp": 0.25},
}

ENSEMBLES = (
    ("gbm", "mlp"),
    ("rf", "mlp"),
    ("rf", "gbm"),
    ("rf", "gbm", "mlp"),
    ("lr", "mlp"),
    ("lr", "gbm"),
    ("lr", "gbm", "mlp"),
    ("lr", "rf"),
    ("lr", "rf", "mlp"),
    ("lr", "rf", "gbm"),
    ("lr", "rf", "gbm", "mlp"),
)

START_SEED = 127
N_RUNS = 100
FULL_RUN_SEED = 643
TEST_SHARE = 0.15
FULL_RUN_TEST_SHARE = 0.25
MAX_FEATURES = 60_000
MIN_DOC_FREQUENCY = 3


def seeds(n: int = N_RUNS, start: int = START_SEED) -> list[int]:
    return list(range(start, start + n))


def model_order(models=MODELS, ensembles=ENSEMBLES) -> list[str]:
    """Single models first, then each ensemble as its avg and max variant."""
    order = list(models)
    for members in ensembles:
        key = "-".join(members)
        order += [f"avg-{key}", f"max-{key}"]
    return order


@dataclass(frozen=True)
class LogisticParams:
    inverse_regularization: float = 1.0
    balanced: bool = True
    max_iter: int = 100
    tolerance: float = 1e-4


@dataclass(frozen=True)
class ForestParams:
    trees: int = 100
    feature_share: float = 0.12
    min_leaf: int = 1
    criterion: str = "entropy"
    max_depth: int = 30
    balanced: bool = True


@dataclass(frozen=True)
class BoostingParams:
    iterations: int = 100
    learning_rate: float = 0.1
    row_share: float = 1.0
    feature_share: float = 0.5
    min_leaf: int = 20
    leaves: int = 31
    balanced: bool = True
    # Spark caps nothing by leaf count: a tree of depth d has up to 2**d leaves.
    max_depth: int | None = None
    # Of boosting.fit_boosted alone.
    mode: str = "gbdt"
    bagging_every: int = 0
    l1: float = 0.0
    l2: float = 0.0
    max_bins: int = 255
    drop_share: float = 0.1
    skip_drop: float = 0.5
    max_drop: int = 50

    @property
    def depth(self) -> int:
        if self.max_depth is not None:
            return self.max_depth
        return max(1, (self.leaves - 1).bit_length())


@dataclass(frozen=True)
class PerceptronParams:
    hidden: tuple[int, ...] = (100,)
    batch: int = 128
    max_epochs: int = 100


@dataclass(frozen=True)
class StudyParams:
    lr: dict = field(default_factory=lambda: {
        "ia": LogisticParams(inverse_regularization=0.336),
        "ps": LogisticParams(),
    })
    rf: dict = field(default_factory=lambda: {
        "ia": ForestParams(trees=108, feature_share=0.12, min_leaf=3),
        "ps": ForestParams(trees=116, feature_share=0.114, min_leaf=5),
    })
    gbm: dict = field(default_factory=lambda: {
        "ia": BoostingParams(iterations=150, learning_rate=0.1, row_share=0.5, min_leaf=3, leaves=50, mode="dart", bagging_every=5),
        "ps": BoostingParams(iterations=172, learning_rate=0.25, row_share=0.7, min_leaf=5, bagging_every=6),
    })
    mlp: dict = field(default_factory=lambda: {
        "ia": PerceptronParams(),
        "ps": PerceptronParams(),
    })


STUDY = StudyParams()
