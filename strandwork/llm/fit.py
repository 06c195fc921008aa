"""Small models fitted on the driver to bounded samples of features."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression (the last one is the intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def nonnegative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 2500, batch: int = 1024, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7, apart: bool = False) -> tuple[list[np.ndarray], list[float]]:
    """Weights of a one-layer network fitted to the non-negative PU risk, and the risk after each epoch.

    With g the network's output and sigmoid losses, the risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]):
    the second part estimates the negatives' risk without a single negative. Where a batch makes it
    negative the step goes up that part's gradient instead, so that the network can't fit the
    unlabelled rows below zero risk (Kiryo et al. 2017). The loss is the logistic one, whose minimiser is the log odds.
    With `apart` the unlabelled rows are taken for negatives, so that the network tells the two samples apart.
    """
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log(prior / (1 - prior))), np.zeros(d)]
    first, second, t, history = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0, []

    def back(x: np.ndarray, h: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        hidden_slope = slope[:, None] * w[2] * (1 - h * h)
        return [x.T @ hidden_slope, hidden_slope.sum(0), h.T @ slope, np.array(slope.sum()), x.T @ slope]

    n_batches = max(1, len(unlabelled) // batch)
    epochs = -(-steps // n_batches)
    for epoch in range(epochs):
        risk, p_order, u_order = 0.0, rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for xp, xu in zip((positive[i] for i in np.array_split(p_order, n_batches)), (unlabelled[i] for i in np.array_split(u_order, n_batches)), strict=True):
            hp, hu = np.tanh(xp @ w[0] + w[1]), np.tanh(xu @ w[0] + w[1])
            gp, gu = hp @ w[2] + xp @ w[4] + w[3], hu @ w[2] + xu @ w[4] + w[3]
            rest = np.logaddexp(0, gu).mean() - (0 if apart else prior * np.logaddexp(0, gp).mean())
            risk += (prior * np.logaddexp(0, -gp).mean() + max(0.0, rest)) / n_batches
            sign = 1.0 if rest >= 0 else -1.0
            slope_p = (0 if apart else -prior * sigmoid(gp) * sign / len(xp)) + (prior * (sigmoid(gp) - 1) / len(xp) if sign > 0 else 0)
            slope_u = sign * sigmoid(gu) / len(xu)
            grads = [a + b + decay * v for a, b, v in zip(back(xp, hp, slope_p), back(xu, hu, slope_u), w, strict=True)]
            t += 1
            now = rate * (1 - epoch / epochs)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] = w[i] - now * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        history.append(float(risk))
    return w, history


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among unlabelled rows, from scores (higher: likelier positive) that neither had a part in fitting.

    Above any threshold the unlabelled rows hold at least their positives' share, prior * share of positives there; so the least ratio
    of the two shares bounds the prior, tightly where the top scores are all positive. The threshold is the one at which the
    ratio is least with its uncertainty added (best bin estimation, Garg et al. 2021).
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    some = p > 0
    p, u = p[some], u[some]
    width = (np.sqrt(np.log(4 / doubt) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / doubt) / (2 * len(positive)))) * 1.01
    best = np.argmin((u + width) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def network(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ w[0] + w[1]) @ w[2] + x @ w[4] + w[3]
