"""Shapes of the tables that operators exchange."""

from __future__ import annotations

SERIES = "entity string, t long, var string, var_idx int, value double"
#: Edges run from i (source) to j (target); an edge that isn't there has weight 0.
EDGES = "window_idx int, i int, j int, lag int, weight double"
EDGE_RUNS = "run_id int, " + EDGES
OPTIMAL_LAGS = "variable string, optimal_lag int"
DETECTIONS = "window_idx int, t_end long, t_center long, status string, abs_score double, change_score double, abs_trend double, threshold_normal double, threshold_change double, threshold_trend double"
POINT_LABELS = "t long, label int"
INTERVAL_LABELS = "event_id int, start long, end long, dims array<int>"
