"""Union of links inside one task, on numpy arrays."""

from __future__ import annotations

import numpy as np


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`label` after the nodes a[i] and b[i] became one group each; label[i] <= i is a root's number."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
