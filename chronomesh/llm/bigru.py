"""A bidirectional gated recurrent network over bytes that labels every position.

Two gated recurrent units run over a window of bytes, one from each end. With x the byte's row of a table, h the state
and s the logistic function::

    z = s(x_z + h U_z)      r = s(x_r + h U_r)      c = tanh(x_c + r * (h U_c))      h' = c + z * (h - c)

A position's label comes from the states of both units there, by a softmax. Training is backpropagation through time
over whole windows, with Adam. Windows are columns of (positions x windows) arrays, filled up with ``PAD``, which is a
byte of its own that gets no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 256


@dataclass
class Unit:
    """One direction: ``table`` is (3, 257, H), what a byte adds to z, r and c; ``across`` is (3, H, H)."""

    table: np.ndarray
    across: np.ndarray


@dataclass
class Network:
    units: tuple[Unit, Unit]
    out: np.ndarray
    bias: np.ndarray

    @property
    def arrays(self) -> list[np.ndarray]:
        return [a for u in self.units for a in (u.table, u.across)] + [self.out, self.bias]


def fresh(hidden: int, labels: int, draw: np.random.Generator, dtype: type = np.float32) -> Network:
    units = tuple(
        Unit((draw.standard_normal((3, PAD + 1, hidden)) * 0.5).astype(dtype),
             (draw.standard_normal((3, hidden, hidden)) / np.sqrt(hidden)).astype(dtype))
        for _ in range(2)
    )
    return Network(units, (draw.standard_normal((2 * hidden, labels)) / np.sqrt(2 * hidden)).astype(dtype), np.zeros(labels, dtype))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _order(length: int, reverse: bool) -> range:
    return range(length - 1, -1, -1) if reverse else range(length)


def states(unit: Unit, x: np.ndarray, reverse: bool) -> tuple[np.ndarray, ...]:
    """States at every position, and what backpropagation needs: (h, z, r, c, h U_c)."""
    length, n = x.shape
    hidden = unit.across.shape[1]
    h, z, r, c, g = (np.empty((length, n, hidden), unit.table.dtype) for _ in range(5))
    before = np.zeros((n, hidden), unit.table.dtype)
    for t in _order(length, reverse):
        add = unit.table[:, x[t]]
        over = before @ unit.across
        z[t], r[t], g[t] = _logistic(add[0] + over[0]), _logistic(add[1] + over[1]), over[2]
        c[t] = np.tanh(add[2] + r[t] * over[2])
        h[t] = before = c[t] + z[t] * (before - c[t])
    return h, z, r, c, g


def _backward(unit: Unit, x: np.ndarray, reverse: bool, kept: tuple[np.ndarray, ...], dh: np.ndarray) -> Unit:
    """Gradients of one unit from those of its states."""
    h, z, r, c, g = kept
    length, n, hidden = h.shape
    d_add, d_across = np.empty((3, length, n, hidden), h.dtype), np.zeros_like(unit.across)
    carry = np.zeros((n, hidden), h.dtype)
    order = list(_order(length, reverse))
    for k in reversed(range(length)):
        t = order[k]
        before = h[order[k - 1]] if k else np.zeros((n, hidden), h.dtype)
        d = dh[t] + carry
        dc = d * (1 - z[t]) * (1 - c[t] ** 2)
        dz = d * (before - c[t]) * z[t] * (1 - z[t])
        dr = dc * g[t] * r[t] * (1 - r[t])
        dg = dc * r[t]
        d_add[:, t] = dz, dr, dc
        carry = d * z[t]
        for i, d_over in enumerate((dz, dr, dg)):
            carry += d_over @ unit.across[i].T
            d_across[i] += before.T @ d_over
    flat, rows = x.ravel(), d_add.reshape(3, -1, hidden)
    order_, d_table = np.argsort(flat, kind="stable"), np.zeros_like(unit.table)
    byte, first = np.unique(flat[order_], return_index=True)
    d_table[:, byte] = np.add.reduceat(rows[:, order_], first, axis=1)
    return Unit(d_table, d_across)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions with a byte, and its gradients in the order of ``net.arrays``."""
    kept = [states(u, x, reverse) for u, reverse in zip(net.units, (False, True))]
    both = np.concatenate([kept[0][0], kept[1][0]], axis=2)
    p = _softmax(both @ net.out + net.bias)
    real = x != PAD
    total = max(int(real.sum()), 1)
    chosen = np.take_along_axis(p, np.broadcast_to(label[None, :, None], (*x.shape, 1)), axis=2)[:, :, 0]
    loss = float(-np.log(np.maximum(chosen, 1e-30))[real].sum() / total)
    d = p
    d[:, np.arange(len(label)), label] -= 1
    d *= real[:, :, None] / d.dtype.type(total)
    d_both, hidden = d @ net.out.T, net.units[0].across.shape[1]
    out = [a for u, reverse, k, part in zip(net.units, (False, True), kept, (d_both[:, :, :hidden], d_both[:, :, hidden:]))
           for g in [_backward(u, x, reverse, k, part)] for a in (g.table, g.across)]
    flat = d.reshape(-1, d.shape[2])
    return loss, [*out, both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)]


def train(net: Network, batches: list[tuple[np.ndarray, np.ndarray]], rate: float) -> list[float]:
    """Adam over the batches in order, the rate falling to a tenth, in place; the loss of every step."""
    first, second = [np.zeros_like(a) for a in net.arrays], [np.zeros_like(a) for a in net.arrays]
    losses = []
    for step, (x, label) in enumerate(batches):
        loss, grads = gradients(net, x, label)
        losses.append(loss)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace, clip = rate * (1 - 0.9 * step / len(batches)), min(1.0, 1.0 / max(size, 1e-12))
        for a, g, m, v in zip(net.arrays, grads, first, second):
            g = g * a.dtype.type(clip)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= a.dtype.type(pace) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
    return losses


class Labeller:
    """Label probabilities of all positions of many windows, with arrays reused between calls."""

    def __init__(self, net: Network):
        # s(x) = 1 / (1 + exp(-x)) and tanh(x) = 1 - 2 / (1 + exp(2 x)): the factors go into the tables
        by = np.array([-1.0, -1.0, 2.0], np.float32)[:, None, None]
        self.units = [([np.ascontiguousarray(t) for t in u.table * by], [np.ascontiguousarray(a) for a in u.across * by]) for u in net.units]
        self.hidden = net.units[0].across.shape[1]
        self.out, self.bias = [net.out[:self.hidden], net.out[self.hidden:]], net.bias

    def _run(self, k: int, x: np.ndarray) -> np.ndarray:
        """What one unit adds to the label scores: (labels, positions * windows)."""
        tables, across = self.units[k]
        n = x.shape[1]
        z, r, c, over = (np.empty((n, self.hidden), np.float32) for _ in range(4))
        h, kept = np.zeros((n, self.hidden), np.float32), np.empty((*x.shape, self.hidden), np.float32)
        for t in _order(len(x), bool(k)):
            for gate, at in ((z, 0), (r, 1)):
                np.take(tables[at], x[t], axis=0, out=gate, mode="clip")
                np.matmul(h, across[at], out=over)
                gate += over
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            np.take(tables[2], x[t], axis=0, out=c, mode="clip")
            np.matmul(h, across[2], out=over)
            over *= r
            c += over
            np.exp(c, out=c)
            c += 1
            np.divide(-2, c, out=c)
            c += 1
            now = kept[t]
            np.subtract(h, c, out=now)
            now *= z
            now += c
            h = now
        return self.out[k].T @ kept.reshape(-1, self.hidden).T

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(labels, positions, windows) probabilities."""
        with np.errstate(over="ignore"):  # exp of a large number is infinite, and its reciprocal 0
            scores = self._run(0, x)
            scores += self._run(1, x)
        scores += self.bias[:, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        return scores.reshape(-1, *x.shape)
