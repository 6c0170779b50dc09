"""The fit of one seasonal ARIMA candidate as a plain loop: what the Spark operator is compared with."""

from __future__ import annotations

import numpy as np

from ledgerlens.operators.forecast.arima import CANDIDATES, FALLBACK, FALLBACK_CID, MIN_SEASONAL


def longest_loss(n: int) -> int:
    """Days that the longest candidate for a series of `n` days loses to differencing and lags."""
    loss = 0
    for (p, d, q), (P, D, Q, s) in candidates(n):
        loss = max(loss, d + s * D + max(p, q, s if P or Q else 0))
    return min(loss, n - 1)


def candidates(n: int) -> list[tuple]:
    """The (order, seasonal order) pairs that a series of `n` days may take."""
    return [(o, so) for _, o, so in CANDIDATES if n >= MIN_SEASONAL or not so[3]]


def _lagmat(x: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k:len(x) - k] for k in lags]) if lags else np.empty((len(x) - start, 0))


def fit_forecast(y: np.ndarray, order, seasonal, h: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit one candidate; return (point forecast, forecast std, AIC). Raises on failure."""
    p, d, q = order
    P, D, Q, s = seasonal
    y = np.asarray(y, dtype=float)
    n = len(y)
    w = np.diff(y) if d else y.copy()
    if D:
        w = w[s:] - w[:-s]
    lost = d + (s if D else 0)
    m = len(w)
    ar = list(range(1, p + 1)) + ([s] if P else [])
    ma = list(range(1, q + 1)) + ([s] if Q else [])
    k = len(ar) + len(ma)
    # stage 1: long autoregression for the innovations
    ehat = np.zeros(m)
    if ma:
        L = int(min(max(10, max(ma) + max(ar or [0])), max(1, m // 3)))
        X1 = _lagmat(w, list(range(1, L + 1)), L)
        beta1, *_ = np.linalg.lstsq(X1, w[L:], rcond=None)
        ehat[L:] = w[L:] - X1 @ beta1
        start = L + max(ma + ar)
    else:
        start = max(ar) if ar else 0
    if m - start < k + 1:
        raise ValueError("fewer observations than least squares needs")
    # stage 2: regression on lagged values and lagged innovations
    X2 = np.column_stack([_lagmat(w, ar, start), _lagmat(ehat, ma, start)]) if k else np.empty((m - start, 0))
    if k:
        coef, *_ = np.linalg.lstsq(X2, w[start:], rcond=None)
    else:
        coef = np.empty(0)
    if not np.all(np.isfinite(coef)):
        raise ValueError("non-finite coefficients")
    a = dict(zip(ar, coef[:len(ar)]))
    b = dict(zip(ma, coef[len(ar):]))
    # innovations by the fitted recursion over the whole differenced series
    e = np.zeros(m)
    for t in range(m):
        pred = sum(c * w[t - i] for i, c in a.items() if t - i >= 0)
        pred += sum(c * e[t - j] for j, c in b.items() if t - j >= 0)
        e[t] = w[t] - pred
    fit_from = min(start, m - 1)
    resid = e[fit_from:]
    sigma2 = float(np.mean(resid ** 2))
    if not np.isfinite(sigma2) or sigma2 <= 0:
        sigma2 = max(sigma2, 1e-12) if np.isfinite(sigma2) else 1e-12
    # AIC on the days that no candidate for this length loses to differencing or lags
    common = longest_loss(n)
    e_y = np.concatenate([np.zeros(lost), e])
    sc = e_y[common:]
    sse = float(np.sum(sc ** 2))
    aic = len(sc) * np.log(max(sse, 1e-300) / len(sc)) + 2 * (k + 1)
    # full AR polynomial in y: (1 - Σ a_i B^i)(1 - B)^d (1 - B^s)^D
    phi = np.zeros(max(ar or [0]) + 1)
    phi[0] = 1.0
    for i, c in a.items():
        phi[i] -= c
    if d:
        phi = np.convolve(phi, [1.0, -1.0])
    if D:
        sd = np.zeros(s + 1)
        sd[0], sd[s] = 1.0, -1.0
        phi = np.convolve(phi, sd)
    cfull = -phi[1:]
    theta = np.zeros(max(ma or [0]) + 1)
    theta[0] = 1.0
    for j, c in b.items():
        theta[j] = c
    ye = list(y)
    ee = list(e_y)
    fc = np.empty(h)
    for step in range(h):
        t = n + step
        v = sum(cfull[i - 1] * ye[t - i] for i in range(1, len(cfull) + 1) if t - i >= 0)
        v += sum(theta[j] * ee[t - j] for j in range(1, len(theta)) if t - j >= 0)
        fc[step] = v
        ye.append(v)
        ee.append(0.0)
    psi = np.zeros(h)
    for j in range(h):
        val = theta[j] if j < len(theta) else 0.0
        val += sum(cfull[i - 1] * psi[j - i] for i in range(1, min(j, len(cfull)) + 1))
        psi[j] = val if j else 1.0
    sd_k = np.sqrt(sigma2 * np.cumsum(psi ** 2))
    if not (np.all(np.isfinite(fc)) and np.all(np.isfinite(sd_k)) and np.isfinite(aic)):
        raise ValueError("non-finite forecast")
    return fc, sd_k, float(aic)


def fit_best(y: np.ndarray, h: int, cid: int | None = None) -> tuple[int, np.ndarray, np.ndarray, float]:
    """(candidate, forecast, forecast std, AIC) of the best candidate, or of candidate `cid`.

    A candidate that fails is left out; if all do, (1, 1, 1) is fitted with fewer terms."""
    fits = []
    for i, order, seasonal in CANDIDATES:
        if (cid is None and (order, seasonal) in candidates(len(y))) or i == cid:
            try:
                fc, sd, aic = fit_forecast(y, order, seasonal, h)
                fits.append((aic, i, fc, sd))
            except (ValueError, np.linalg.LinAlgError):
                continue
    if fits:
        aic, i, fc, sd = min(fits, key=lambda f: f[:2])
        return i, fc, sd, aic
    for order in (FALLBACK, (1, 1, 0), (0, 1, 0)):
        try:
            fc, sd, aic = fit_forecast(y, order, (0, 0, 0, 0), h)
            break
        except (ValueError, np.linalg.LinAlgError):
            continue
    else:
        fc, sd, aic = np.full(h, float(y[-1])), np.zeros(h), float("inf")
    return FALLBACK_CID, fc, sd, aic
