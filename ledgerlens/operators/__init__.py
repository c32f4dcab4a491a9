"""Operators; importing them registers their queries."""

from ..streaming import windows as _streams  # noqa: F401
from . import anomaly, beam, betweenness, clean, evaluation, families, features, fifo, graph, importance, inferred, intraday, layouts, modularity, network, outputs, parties, paths, printed, propagation, relations, risk, scores, serving, short_cycles, statements, strong, taint, trails, windows  # noqa: F401
