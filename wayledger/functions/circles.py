"""Circles seen in perspective: from points clicked around one, evenly spaced points on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

POINTS = 15  # enough to define the circle, few enough to be moved by hand


def _project(h: np.ndarray, circle: np.ndarray) -> np.ndarray:
    p = np.column_stack([circle, np.ones(len(circle))]) @ np.append(h, 1.0).reshape(3, 3).T
    return p[:, :2] / p[:, 2:]


def solve_circle(points: np.ndarray, n: int = POINTS, rounds: int = 30) -> np.ndarray:
    """``n`` points of the view of a circle on which ``points`` lie, in order and about evenly spaced.

    An affine view is fitted first; with five points or more, a perspective one by damped least squares from there.
    """
    points = np.asarray(points, float)
    if len(points) < 3:
        raise ValueError("a circle takes three points")
    angles = np.arange(len(points)) * 2 * np.pi / len(points)
    circle = np.column_stack([np.cos(angles), np.sin(angles)])
    center, scale = points.mean(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-9)
    view = (points - center) / scale
    affine, *_ = np.linalg.lstsq(np.column_stack([circle, np.ones(len(circle))]), view, rcond=None)
    h = np.array([affine[0, 0], affine[1, 0], affine[2, 0], affine[0, 1], affine[1, 1], affine[2, 1], 0.0, 0.0])
    if len(points) >= 5:
        damping, error = 1e-3, float(((_project(h, circle) - view) ** 2).sum())
        for _ in range(rounds):
            base = _project(h, circle).ravel()
            slope = np.column_stack([(_project(h + 1e-6 * e, circle).ravel() - base) / 1e-6 for e in np.eye(8)])
            step = np.linalg.solve(slope.T @ slope + damping * np.eye(8), slope.T @ (view.ravel() - base))
            moved = float(((_project(h + step, circle) - view) ** 2).sum())
            if moved < error:
                h, error, damping = h + step, moved, damping / 4
            else:
                damping *= 8
    at = np.arange(n) * 2 * np.pi / n
    return _project(h, np.column_stack([np.cos(at), np.sin(at)])) * scale + center


def solve_circles(points: DataFrame, circle: str = "circle_id", order: str = "n", x: str = "x", y: str = "y") -> DataFrame:
    """(circle, n, x, y): the points of each circle, from a few clicked ones each; null for fewer than three."""
    schema = f"{circle} {points.schema[circle].dataType.simpleString()}, n int, x double, y double"

    def run(key: tuple, clicked: pd.DataFrame) -> pd.DataFrame:
        clicked = clicked.sort_values(order).dropna(subset=[x, y])
        if len(clicked) < 3:
            return pd.DataFrame({circle: [key[0]], "n": [None], "x": [None], "y": [None]})
        out = solve_circle(clicked[[x, y]].to_numpy())
        return pd.DataFrame({circle: key[0], "n": range(len(out)), "x": out[:, 0], "y": out[:, 1]})

    return points.select(circle, order, x, y).groupBy(circle).applyInPandas(run, schema)
