"""Fourier operators along an axis, and small dense linear algebra."""

from __future__ import annotations

import numpy as np

from lattica.ndarray import NdArray, along_lines


def fft_real(x: np.ndarray) -> np.ndarray:
    """Real Fourier coefficients along the last axis: mean, then cosine and sine of each frequency, and the last cosine for even sizes."""
    n = x.shape[-1]
    c = np.fft.rfft(x) / n
    out = np.empty(x.shape)
    out[..., 0] = c[..., 0].real
    k = np.arange(1, (n + 1) // 2)
    out[..., 2 * k - 1], out[..., 2 * k] = 2 * c[..., k].real, -2 * c[..., k].imag
    if n % 2 == 0:
        out[..., -1] = c[..., -1].real
    return out


def fft_real_inverse(f: np.ndarray) -> np.ndarray:
    n = f.shape[-1]
    c = np.zeros((*f.shape[:-1], n // 2 + 1), complex)
    c[..., 0] = f[..., 0]
    k = np.arange(1, (n + 1) // 2)
    c[..., k] = (f[..., 2 * k - 1] - 1j * f[..., 2 * k]) / 2
    if n % 2 == 0:
        c[..., -1] = f[..., -1]
    return np.fft.irfft(c * n, n)


def fft(a: NdArray, axis: int = 0) -> NdArray:
    return along_lines(a, axis, lambda x, at: fft_real(x))


def fftb(a: NdArray, axis: int = 0) -> NdArray:
    """Inverse of `fft`."""
    return along_lines(a, axis, lambda x, at: fft_real_inverse(x))


def cosines(x: np.ndarray) -> np.ndarray:
    """Cosine transform along the last axis of lines whose edges repeat."""
    n = x.shape[-1]
    turn = np.exp(-0.5j * np.pi * np.arange(n) / n)
    return (np.fft.rfft(np.concatenate([x, x[..., ::-1]], axis=-1))[..., :n] * turn).real


def cosines_inverse(c: np.ndarray) -> np.ndarray:
    n = c.shape[-1]
    f = np.zeros((*c.shape[:-1], n + 1), complex)
    f[..., :n] = c * np.exp(0.5j * np.pi * np.arange(n) / n)
    return np.fft.irfft(f, 2 * n)[..., :n]


def sc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine series of a line."""
    c = np.fft.rfft(x) / len(x)
    scale = np.full(len(c), 2.0)
    scale[0] = 1
    if len(x) % 2 == 0:
        scale[-1] = 1
    return -c.imag * scale, c.real * scale


def scb(sine: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
    """Line of n values from its sine and cosine series."""
    scale = np.full(len(cosine), 2.0)
    scale[0] = 1
    if n % 2 == 0:
        scale[-1] = 1
    return np.fft.irfft((cosine - 1j * sine) / scale * n, n)


def power(a: NdArray, axis: int = 0) -> NdArray:
    """Power at each frequency, 0 first."""
    n = a.dims[a.axis(axis)]
    return along_lines(a, axis, lambda x, at: np.abs(np.fft.rfft(x) / x.shape[-1]) ** 2 * np.concatenate([[1], np.full(x.shape[-1] // 2, 2.0)]), n // 2 + 1)


def fftshift(a: NdArray, by: float, axis: int = 0) -> NdArray:
    """Moved by a fraction of a cell, around the end."""
    return along_lines(a, axis, lambda x, at: np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * np.arange(x.shape[-1] // 2 + 1) * by / x.shape[-1]), x.shape[-1]))


def hilbert(a: NdArray, axis: int = 0) -> NdArray:
    """Every phase advanced by a quarter turn."""
    return along_lines(a, axis, lambda x, at: np.fft.irfft(np.fft.rfft(x) * np.where(np.arange(x.shape[-1] // 2 + 1) > 0, 1j, 0), x.shape[-1]))


def fftexpand(a: NdArray, factor: float, axis: int = 0) -> NdArray:
    """Enlarged by Fourier interpolation."""
    n = round(a.dims[a.axis(axis)] * factor)
    return along_lines(a, axis, lambda x, at: np.fft.irfft(np.fft.rfft(x), n) * (n / x.shape[-1]), n)


def welch(x: np.ndarray, size: int, window: bool = True) -> np.ndarray:
    """Mean periodogram of half-overlapping frames."""
    w = np.hanning(size) if window else np.ones(size)
    parts = [np.abs(np.fft.rfft(x[k : k + size] * w)) ** 2 for k in range(0, len(x) - size + 1, max(1, size // 2))]
    return np.mean(parts, axis=0) / (w**2).sum()


def svd(a: np.ndarray):
    return np.linalg.svd(a, full_matrices=False)


def eigensystem(a: np.ndarray):
    """Values (ascending) and vectors of a real symmetric matrix."""
    return np.linalg.eigh(a)


def eigenvalues(a: np.ndarray, ascending: bool = False, absolute: bool = True) -> np.ndarray:
    v = np.linalg.eigvalsh(a)
    order = np.argsort(np.abs(v) if absolute else v)
    return v[order] if ascending else v[order[::-1]]


def decomp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LU factors in one matrix, and the order of rows (partial pivoting)."""
    lu, order = np.array(a, float), np.arange(len(a))
    for k in range(len(lu)):
        p = k + int(np.abs(lu[k:, k]).argmax())
        lu[[k, p]], order[[k, p]] = lu[[p, k]], order[[p, k]]
        if lu[k, k]:
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 :] -= np.outer(lu[k + 1 :, k], lu[k, k + 1 :])
    return lu, order


def dsolve(lu: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of the system whose factors `decomp` gave."""
    x = np.asarray(b, float)[order].copy()
    for k in range(len(x)):
        x[k] -= lu[k, :k] @ x[:k]
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] - lu[k, k + 1 :] @ x[k + 1 :]) / lu[k, k]
    return x
