"""Minimising many smooth functions at once by limited-memory quasi-Newton steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise(value_and_slope: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, memory: int = 10, steps: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Minima of ``len(start)`` functions; ``value_and_slope(points, which)`` gives values and slopes of the functions ``which``.

    Each function has its own history and step; those that have come to rest are not asked again.
    A function rests when its slope is under ``tolerance`` of its value, or no step lessens it.
    """
    w = start.copy()
    live = np.arange(len(w))
    f, g = np.full(len(w), np.inf), np.zeros_like(w)
    if len(live):
        f[live], g[live] = value_and_slope(w, live)
    moves, turns, scale = [], [], np.ones(len(w))
    for _ in range(steps):
        live = live[np.abs(g[live]).max(1, initial=0) > tolerance * (1 + np.abs(f[live]))]
        if not len(live):
            break
        d = g[live].copy()
        kept = []
        for s, t in zip(reversed(moves), reversed(turns), strict=True):
            curve = (s[live] * t[live]).sum(1)
            rate = np.divide((s[live] * d).sum(1), curve, out=np.zeros(len(live)), where=curve > 0)
            d -= rate[:, None] * t[live]
            kept.append((s, t, curve, rate))
        d *= scale[live, None]
        for s, t, curve, rate in reversed(kept):
            back = np.divide((t[live] * d).sum(1), curve, out=np.zeros(len(live)), where=curve > 0)
            d += (rate - back)[:, None] * s[live]
        slope = (d * g[live]).sum(1)
        wrong = slope <= 0
        d[wrong], slope[wrong] = g[live][wrong], (g[live][wrong] ** 2).sum(1)
        if not moves:
            d, slope = d / (1 + np.abs(g[live]).max(1))[:, None], slope / (1 + np.abs(g[live]).max(1))
        size, todo = np.ones(len(live)), np.ones(len(live), bool)
        new_w, new_f, new_g = w[live].copy(), f[live].copy(), g[live].copy()
        for _ in range(30):
            at = np.flatnonzero(todo)
            tried = w[live[at]] - size[at, None] * d[at]
            value, grad = value_and_slope(tried, live[at])
            good = value <= f[live[at]] - 1e-4 * size[at] * slope[at]
            # near the minimum values differ by rounding alone: there a flatter slope counts
            level = value <= f[live[at]] + 1e-12 * (1 + np.abs(f[live[at]]))
            good |= level & (np.abs(grad).max(1, initial=0) < 0.9 * np.abs(g[live[at]]).max(1, initial=0))
            new_w[at[good]], new_f[at[good]], new_g[at[good]] = tried[good], value[good], grad[good]
            todo[at[good]] = False
            size[at[~good]] *= 0.4
            if not todo.any():
                break
        s, t = np.zeros_like(w), np.zeros_like(w)
        s[live], t[live] = new_w - w[live], new_g - g[live]
        curve = (s * t).sum(1)
        bad = curve <= 1e-14 * np.maximum((t * t).sum(1), 1e-300)
        s[bad], t[bad], curve[bad] = 0, 0, 0
        scale = np.divide(curve, (t * t).sum(1), out=scale, where=curve > 0)
        moves, turns = [*moves[-memory + 1 :], s], [*turns[-memory + 1 :], t]
        w[live], f[live], g[live] = new_w, new_f, new_g
        live = live[~todo]
    return w
