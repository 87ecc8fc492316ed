"""Losses of the trained models, on `autograd` variables."""

from __future__ import annotations

import numpy as np

from toplane.functions.autograd import Var, exp, log_sigmoid, log_softmax, relu, sigmoid, var


def bpr_loss(positive: Var, negative: Var) -> Var:
    """-mean log sigmoid(positive - negative)."""
    return -log_sigmoid(positive - negative).mean()


def skipgram_negative_sampling_loss(positive: Var, negative: Var) -> Var:
    """positive (n), negative (n, k)."""
    return -(log_sigmoid(positive) + log_sigmoid(-negative).sum(1)).mean()


def bpr_max_loss(positive: Var, negative: Var, reg: float = 0.0) -> Var:
    """positive (n), negative (n, k): negatives are weighed by their softmax."""
    w = exp(log_softmax(negative))
    gap = positive[(slice(None), None)] - negative
    inner = (w * sigmoid(gap)).sum(1)
    from toplane.functions.autograd import log

    return (-log(inner + 1e-12) + reg * (w * negative**2).sum(1)).mean()


def top1_loss(positive: Var, negative: Var) -> Var:
    return (sigmoid(negative - positive[(slice(None), None)]) + sigmoid(negative**2)).mean()


def top1_max_loss(positive: Var, negative: Var) -> Var:
    w = exp(log_softmax(negative))
    return (w * (sigmoid(negative - positive[(slice(None), None)]) + sigmoid(negative**2))).sum(1).mean()


def warp_loss(positive: Var, negative: Var, margin: float, num_items: int) -> Var:
    """Hinge on the first violating negative of each row, by the log of its estimated rank."""
    gap = margin - positive.data[:, None] + negative.data
    bad = gap > 0
    first = bad.argmax(1)
    any_bad = bad.any(1)
    rank = np.where(any_bad, np.log1p(np.maximum((num_items - 1) // (first + 1), 1)), 0.0)
    rows = np.arange(len(first))
    return (relu(margin - positive + negative[(rows, first)]) * var(rank)).mean()


def covariance_loss(users: Var, items: Var) -> Var:
    """Sum of the off-diagonal covariances of the embeddings."""
    total = var(0.0)
    both = [users, items]
    n = sum(len(x.data) for x in both)
    mean = (users.sum(0) + items.sum(0)) * (1.0 / n)
    cov = None
    for x in both:
        c = x - mean
        part = c.T @ c
        cov = part if cov is None else cov + part
    cov = cov * (1.0 / n)
    off = 1 - np.eye(cov.data.shape[0])
    return total + (cov * var(off) * cov).sum() * (1.0 / users.data.shape[1])


def vae_loss(logits: Var, mean: Var, logvar: Var, x: np.ndarray, anneal: float = 1.0) -> Var:
    """Multinomial log-likelihood plus the annealed divergence from a standard normal."""
    like = (log_softmax(logits) * var(x)).sum(1).mean()
    kl = (1 + logvar - mean**2 - exp(logvar)).sum(1).mean() * -0.5
    return -like + anneal * kl


LOSSES = {"bpr": bpr_loss, "bpr-max": bpr_max_loss, "top1": top1_loss, "top1-max": top1_max_loss}
