"""Numpy arithmetic on one bounded block of samples; no Spark in here."""

from __future__ import annotations

import numpy as np

# --- fixed values -----------------------------------------------------------
SINC_ZEROS = 64
SINC_ROLLOFF = 0.9475937167399596
SINC_BETA = 14.769656459379492
FRAME = 256
OVERLAP = 128
# -----------------------------------------------------------------------------


def sinc_reach(fs: int, target: int) -> int:
    """Input samples needed on each side of an output position."""
    return int(np.ceil(SINC_ZEROS / min(1.0, target / fs))) + 1


def sinc_resample(x: np.ndarray, first: int, begin: int, end: int, fs: int, target: int) -> np.ndarray:
    """Band-limited outputs ``[begin, end)``; ``x[0]`` is input sample ``first``."""
    scale = min(1.0, target / fs)
    at = np.arange(begin, end) * (fs / target)
    reach = sinc_reach(fs, target)
    taps = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)[None, :]
    u = scale * (at[:, None] - taps)
    inside = np.abs(u) < SINC_ZEROS
    shape = np.where(inside, 1.0 - (u / SINC_ZEROS) ** 2, 0.0)
    weight = SINC_ROLLOFF * np.sinc(SINC_ROLLOFF * u) * np.i0(SINC_BETA * np.sqrt(shape)) / np.i0(SINC_BETA)
    weight = np.where(inside, weight, 0.0) * scale
    local = taps - first
    known = (local >= 0) & (local < len(x))
    return np.sum(np.where(known, x[np.clip(local, 0, len(x) - 1)], 0.0) * weight, axis=1)


def butterworth(order: int, low: float | None, high: float | None, fs: float):
    """Digital Butterworth zeros, poles and gain by the bilinear transform.

    Only ``low``: high-pass above it; only ``high``: low-pass below it; both:
    band-pass between them.
    """
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 4.0 * np.tan(np.pi * f / fs)  # noqa: E731  (rate 2 bilinear)
    if low is not None and high is not None:
        w1, w2 = warp(low), warp(high)
        width, mid = w2 - w1, w1 * w2
        half = poles * width / 2
        root = np.sqrt(half**2 - mid + 0j)
        p = np.concatenate([half + root, half - root])
        z, gain = np.zeros(order), width**order
    elif high is not None:
        w = warp(high)
        p, z, gain = poles * w, np.zeros(0), w**order
    elif low is not None:
        w = warp(low)
        p, z, gain = w / poles, np.zeros(order), 1.0
    else:
        raise ValueError("a filter needs a low or a high frequency")
    gain = gain * np.real(np.prod(4.0 - z) / np.prod(4.0 - p))
    zd = np.concatenate([(4.0 + z) / (4.0 - z), -np.ones(len(p) - len(z))])
    pd = (4.0 + p) / (4.0 - p)
    return zd, pd, gain


def _sections(z, p, gain):
    """Group conjugate poles into second-order sections with paired zeros."""
    complex_p = sorted((q for q in p if q.imag > 1e-12), key=abs)
    real_p = sorted(q.real for q in p if abs(q.imag) <= 1e-12)
    pairs = [np.real(np.poly([q, np.conj(q)])) for q in complex_p]
    pairs += [np.poly(real_p[i : i + 2]) for i in range(0, len(real_p), 2)]
    zeros = sorted(np.real(z))
    # One zero from each end: a band-pass pairs -1 with +1 in every section.
    tops = []
    for bottom in pairs:
        take = [zeros.pop(0)] if zeros else []
        if len(bottom) == 3 and zeros:
            take.append(zeros.pop(-1))
        tops.append(np.poly(take) if take else np.ones(1))
    tops[0] = tops[0] * gain
    return list(zip(tops, pairs))


def impulse_response(order: int, low, high, fs, tolerance: float = 1e-12) -> np.ndarray:
    """Response cut where what follows is below ``tolerance``."""
    z, p, gain = butterworth(order, low, high, fs)
    radius = float(np.max(np.abs(p)))
    if radius >= 1:
        raise ValueError("unstable filter")
    # Equal poles multiply the decay by a polynomial: leave room for it.
    length = int(np.ceil(np.log(tolerance) / np.log(radius) * 1.5)) + 16 * order
    h = np.zeros(length)
    h[0] = 1.0
    for b, a in _sections(z, p, gain):
        y = np.zeros(length)
        fed = np.convolve(h, b)[:length]
        a1 = a[1] if len(a) > 1 else 0.0
        a2 = a[2] if len(a) > 2 else 0.0
        y1 = y2 = 0.0
        for i in range(length):
            y0 = fed[i] - a1 * y1 - a2 * y2
            y[i] = y0
            y2, y1 = y1, y0
        h = y
    keep = np.nonzero(np.abs(h) > tolerance * np.max(np.abs(h)) * 1e-2)[0]
    return h[: keep[-1] + 1]


def edge_padding(order: int, low, high) -> int:
    """Odd extension length at record ends for the zero-phase filter."""
    band = low is not None and high is not None
    sections = order if band else (order + 1) // 2
    taps = 2 * sections + 1
    if not band and order % 2 == 1:
        taps -= 1
    return 3 * taps


def convolve_causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def filter_block(x: np.ndarray, at_start: bool, at_end: bool, h: np.ndarray, pad: int, zero_phase: bool) -> np.ndarray:
    """Filter a block that carries enough context; result has the input length.

    At a record end the zero-phase filter extends the signal oddly by ``pad``
    and starts each pass from the steady state of its first value; the causal
    filter starts from rest.
    """
    reach = len(h)
    if zero_phase and (at_start or at_end) and len(x) <= pad:
        raise ValueError(f"a record of {len(x)} samples is not longer than the padding of {pad}")
    if not zero_phase:
        return convolve_causal(x, h)
    left, right = 0, 0
    if at_start:
        left = pad
        x = np.concatenate([2 * x[0] - x[left:0:-1], x])
    if at_end:
        right = pad
        x = np.concatenate([x, 2 * x[-1] - x[-2 : -right - 2 : -1]])
    hold = np.full(reach, x[0])
    forward = convolve_causal(np.concatenate([hold, x]), h)[reach:]
    hold = np.full(reach, forward[-1])
    back = convolve_causal(np.concatenate([hold, forward[::-1]]), h)[reach:][::-1]
    return back[left : len(back) - right]


def spectrogram_frames(x: np.ndarray, fs: float, size: int, hop: int, log: bool) -> np.ndarray:
    """One-sided power density per frame: Hann window, mean removed."""
    count = (len(x) - size) // hop + 1
    if count <= 0:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:count]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    power /= fs * np.sum(window**2)
    power[:, 1 : (size + 1) // 2] *= 2
    if log:
        power = 20 * np.log10(np.abs(power) + np.finfo(float).eps)
    return power
