"""Cross-correlation of one pair of signals (numpy, on the executors)."""



import numpy as np
import pandas as pd


def best_lag(x: np.ndarray, y: np.ndarray) -> int | None:
    """Lag with the greatest sum of x[i] y[i - lag], over all lags, the least of equals; None for a constant or empty side.

    The FFT finds the peak up to rounding; lags within rounding of it are summed directly.
    """
    if not len(x) or not len(y):
        return None
    x, y = x - x.mean(), y - y.mean()
    rx, ry = np.sqrt((x * x).mean()), np.sqrt((y * y).mean())
    if not (np.isfinite(rx) and np.isfinite(ry) and rx > 0 and ry > 0):
        return None
    x, y = x / rx, y / ry
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[:n]
    near = np.flatnonzero(c >= c.max() - 1e-9 * max(1.0, abs(c.max())))

    def direct(k: int) -> float:
        lag = k - (len(y) - 1)
        a, b = max(0, lag), min(len(x), len(y) + lag)
        return float(x[a:b] @ y[a - lag : b - lag])

    best = max(near, key=lambda k: (round(direct(k), 9), -k))
    return int(best) - (len(y) - 1)


def lag_of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    lag = best_lag(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
    return pd.DataFrame({pdf.columns[0]: [key[0]], "lag_samples": pd.array([lag], dtype="Int64")})
