"""One frozen parameter set: the data contract of the whole chain."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping

# Fixed values that results depend on (same numbers as the original service).
# Risk level bands, left-closed: low [0, .33), medium [.33, .66), high otherwise.
LEVEL_LOW_MAX = 0.33
LEVEL_MEDIUM_MAX = 0.66
# Composite weights before normalisation.
DEFAULT_WEIGHTS = {
    "model_score": 0.50,
    "anomaly_score": 0.25,
    "spatial_density": 0.15,
    "temporal_weight": 0.10,
}
# Column names that mark a target, and latitude / longitude, matched lower-cased in table order.
TARGET_NAMES = ("label", "target", "class", "risk", "anomaly", "y")
LAT_NAMES = ("latitude", "lat", "y_coord", "y")
LON_NAMES = ("longitude", "lon", "lng", "x_coord", "x")
# Text values read as missing from CSV (pandas' default NA tokens).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Params:
    seed: int = 42
    test_size: float = 0.2
    validation_size: float = 0.1
    imputation: str = "median"          # median | mean | most_frequent
    scaling: str = "standard"           # standard | minmax | robust
    outlier_method: str = "iqr"         # iqr | zscore | none
    outlier_threshold: float = 3.0
    geo_features: bool = True
    temporal_features: bool = True
    # exact: order statistics by histogram refinement (exact, bounded memory);
    # approx: percentile_approx with `approx_accuracy`.
    quantiles: str = "exact"
    approx_accuracy: int = 10000
    # where the fitted statistics come from: "all" rows (as the original) or the "train" split only
    fit_on: str = "all"
    clip_on_transform: bool = False
    # models
    rf_trees: int = 200
    rf_depth: int = 15
    rf_min_split: int = 5
    gbt_rounds: int = 300
    gbt_depth: int = 6
    gbt_rate: float = 0.05
    gbt_subsample: float = 0.8
    gbt_colsample: float = 0.8
    gbt_bins: int = 64                  # bins a feature (up to 256)
    gbt_bin_rows: int = 200_000         # rows from which the bins' edges are taken
    lr_max_iter: int = 1000
    lr_c: float = 1.0
    models: tuple = ("random_forest", "gradient_boosting", "logistic_regression")
    anomaly: bool = True
    cv_folds: int = 5
    parallel_fits: int = 3              # fits of models or folds that run at the same time
    # isolation forest
    if_trees: int = 200
    if_sample: int = 256
    if_contamination: float = 0.1
    # risk engine
    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    level_low_max: float = LEVEL_LOW_MAX
    level_medium_max: float = LEVEL_MEDIUM_MAX
    kde_bandwidth: float = 0.5
    # spatial density: grid cells of side kde_cell bandwidths; what radius and order leave out of a kernel sum
    kde_cell: float = 0.5
    kde_tolerance: float = 1e-9
    broadcast_max_rows: int = 2_000_000
    broadcast_max_bytes: int = 128 << 20     # with the row limit: a side is broadcast only under both

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    def norm_weights(self) -> dict:
        """The given weights divided by their sum (sum 0 -> divide by 1); a key that is
        not given takes its default value as is."""
        given = dict(self.weights or {})
        total = sum(given.values()) or 1.0
        out = {k: v / total for k, v in given.items()}
        for k, v in DEFAULT_WEIGHTS.items():
            out.setdefault(k, v)
        return out
