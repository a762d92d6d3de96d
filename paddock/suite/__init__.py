"""All registered queries."""

from __future__ import annotations

from paddock.suite import assembly, evaluation, features, form, ml, prediction, quality, report, sessions, sources, training
from paddock.suite.base import Query

QUERIES: dict[str, Query] = {**form.QUERIES, **features.QUERIES, **assembly.QUERIES, **quality.QUERIES, **prediction.QUERIES, **report.QUERIES, **sessions.QUERIES, **evaluation.QUERIES, **sources.QUERIES, **ml.QUERIES, **training.QUERIES}
