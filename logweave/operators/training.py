"""The periodic training job: both models from the last days of logs."""

from dataclasses import dataclass
from typing import Optional

from pyspark.sql import DataFrame

from logweave.operators.analytics import feature_matrix
from logweave.operators.anomaly import Forest, iforest_fit, train_summary
from logweave.operators.filters import filter_errors, filter_last
from logweave.operators.patterns import Patterns, fit_patterns
from logweave.session import materialize

# Rows the models are trained on.
TRAINING_DAYS = 7


@dataclass
class Models:
    forest: Optional[Forest]
    patterns: Optional[Patterns]
    summary: DataFrame


def train_all(df, as_of=None, days=TRAINING_DAYS):
    """Forest on hourly features and patterns on warnings and errors; run it on a schedule.

    All messages take part: the templates make a sample unnecessary.
    """
    recent = filter_last(df, f"{days} DAYS", as_of)
    features = materialize(feature_matrix(recent), "features")
    messages = filter_errors(recent, with_warnings=True)
    patterns = fit_patterns(messages)
    return Models(iforest_fit(features), patterns,
                  train_summary(features, messages, patterns.clusters if patterns else None))
