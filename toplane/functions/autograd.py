"""Reverse-mode gradients for numpy arrays: the few operations that the trained models need."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def _unbroadcast(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis, keepdims=True)
    return g


class Var:
    """An array, its gradient, and how the gradient goes on to what it was made from."""

    def __init__(self, data, parents: tuple[Var, ...] = (), back: Callable[[np.ndarray], tuple] | None = None) -> None:
        self.data = np.asarray(data, float)
        self.parents, self.back = parents, back
        self.grad: np.ndarray | None = None

    @property
    def shape(self):
        return self.data.shape

    def backward(self) -> None:
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        for v in order:
            v.grad = None
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is None or v.grad is None:
                continue
            for p, g in zip(v.parents, v.back(v.grad), strict=True):
                if g is not None:
                    g = _unbroadcast(g, p.data.shape)
                    p.grad = g if p.grad is None else p.grad + g

    def __add__(self, o):
        o = var(o)
        return Var(self.data + o.data, (self, o), lambda g: (g, g))

    def __mul__(self, o):
        o = var(o)
        return Var(self.data * o.data, (self, o), lambda g: (g * o.data, g * self.data))

    def __truediv__(self, o):
        return self * var(o) ** -1

    def __pow__(self, n: float):
        return Var(self.data**n, (self,), lambda g: (g * n * self.data ** (n - 1),))

    def __matmul__(self, o):
        return Var(self.data @ o.data, (self, o), lambda g: (g @ np.swapaxes(o.data, -1, -2), np.swapaxes(self.data, -1, -2) @ g))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -var(o)

    def __rsub__(self, o):
        return var(o) + -self

    __radd__, __rmul__ = __add__, __mul__

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return (out,)

        return Var(self.data[at], (self,), back)

    @property
    def T(self):
        return Var(self.data.T, (self,), lambda g: (g.T,))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return (np.broadcast_to(g, self.data.shape),)

        return Var(self.data.sum(axis, keepdims=keepdims), (self,), back)

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else self.data.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def exp(x: Var) -> Var:
    y = np.exp(np.clip(x.data, -60, 60))
    return Var(y, (x,), lambda g: (g * y,))


def log(x: Var) -> Var:
    return Var(np.log(x.data), (x,), lambda g: (g / x.data,))


def tanh(x: Var) -> Var:
    y = np.tanh(x.data)
    return Var(y, (x,), lambda g: (g * (1 - y * y),))


def sigmoid(x: Var) -> Var:
    y = _sig(x.data)
    return Var(y, (x,), lambda g: (g * y * (1 - y),))


def log_sigmoid(x: Var) -> Var:
    return Var(-np.logaddexp(0, -x.data), (x,), lambda g: (g * _sig(-x.data),))


def relu(x: Var) -> Var:
    on = x.data > 0
    return Var(x.data * on, (x,), lambda g: (g * on,))


def log_softmax(x: Var) -> Var:
    y = x.data - x.data.max(-1, keepdims=True)
    y = y - np.log(np.exp(y).sum(-1, keepdims=True))
    return Var(y, (x,), lambda g: (g - np.exp(y) * g.sum(-1, keepdims=True),))


def log_sum_exp(parts: list[Var]) -> Var:
    """Elementwise over the parts."""
    most = np.max([p.data for p in parts], 0)
    total = sum(np.exp(p.data - most) for p in parts)
    return Var(most + np.log(total), tuple(parts), lambda g: tuple(g * np.exp(p.data - most) / total for p in parts))


class Optimiser:
    """SGD, Adagrad or Adam over named parameters."""

    def __init__(self, params: dict[str, Var], kind: str = "adam", lr: float = 0.01, clip: float | None = None) -> None:
        self.params, self.kind, self.lr, self.clip = params, kind, lr, clip
        self.m = {k: np.zeros_like(p.data) for k, p in params.items()}
        self.v = {k: np.zeros_like(p.data) for k, p in params.items()}
        self.t = 0

    def step(self, only: set[str] | None = None) -> None:
        self.t += 1
        live = {k: p for k, p in self.params.items() if p.grad is not None and (only is None or k in only)}
        scale = 1.0
        if self.clip:
            norm = np.sqrt(sum(float((p.grad**2).sum()) for p in live.values()))
            scale = min(1.0, self.clip / (norm + 1e-12))
        for k, p in live.items():
            g = p.grad * scale
            if self.kind == "sgd":
                p.data = p.data - self.lr * g
            elif self.kind == "adagrad":
                self.v[k] += g * g
                p.data = p.data - self.lr * g / (np.sqrt(self.v[k]) + 1e-10)
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * g
                self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
                p.data = p.data - self.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def step_rows(self, grads: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """A step on some rows of parameters, (row numbers, gradient) each, where those of the others are 0: they stay, except under Adam or clipping."""
        if self.kind == "adam" or self.clip:
            raise ValueError("rows can't be stepped apart under Adam or clipping")
        self.t += 1
        for k, (rows, g) in grads.items():
            if self.kind == "adagrad":
                self.v[k][rows] += g * g
                self.params[k].data[rows] -= self.lr * g / (np.sqrt(self.v[k][rows]) + 1e-10)
            else:
                self.params[k].data[rows] -= self.lr * g
