"""Block-wise signal jobs against direct evaluation of whole records."""

import numpy as np
import pytest

from pulsegrid.operators import kernels
from pulsegrid.operators import signal as G


def make(spark, n=700, seed=0):
    x = np.cumsum(np.random.default_rng(seed).normal(size=n)) * 0.1
    rows = [(1, "i", t, float(v)) for t, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "record_id int, channel string, t int, value double")


def recursion(x, order, low, high, fs, state=None):
    """Direct form of the sections, one sample after the other."""
    y = x
    for i, (b, a) in enumerate(kernels._sections(*kernels.butterworth(order, low, high, fs))):
        b = np.pad(b, (0, 3 - len(b)))
        a = np.pad(a, (0, 3 - len(a)))
        z1 = z2 = 0.0
        if state is not None:
            gain = b.sum() / a.sum()
            z1, z2 = (gain - b[0]) * state, (b[2] - a[2] * gain) * state
            state = gain * state
        out = np.empty(len(y))
        for t, v in enumerate(y):
            o = b[0] * v + z1
            z1, z2 = b[1] * v - a[1] * o + z2, b[2] * v - a[2] * o
            out[t] = o
        y = out
    return y


@pytest.mark.parametrize("low,high,order", [(2.0, 12.0, 3), (None, 10.0, 4), (1.0, None, 3)])
def test_T15_filter(spark, low, high, order):
    x, sig = make(spark)
    fs = 50.0
    for zero_phase in (True, False):
        got = [r["value"] for r in G.butter_filter(sig, fs, low, high, order, zero_phase, block=97).orderBy("t").collect()]
        if zero_phase:
            pad = kernels.edge_padding(order, low, high)
            ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
            forward = recursion(ext, order, low, high, fs, ext[0])
            back = recursion(forward[::-1], order, low, high, fs, forward[-1])[::-1]
            expected = back[pad:-pad]
        else:
            expected = recursion(x, order, low, high, fs)
        assert np.allclose(got, expected, atol=1e-8)


def test_T15_response():
    for low, high, pass_, stop in ((5.0, 15.0, 10.0, 1.0), (None, 10.0, 1.0, 22.0), (10.0, None, 22.0, 1.0)):
        h = kernels.impulse_response(4, low, high, 50.0)
        gain = lambda f: abs(np.sum(h * np.exp(-2j * np.pi * f / 50.0 * np.arange(len(h)))))
        assert gain(pass_) == pytest.approx(1.0, abs=0.02) and gain(stop) < 0.02
        edge = high if low is None else low
        assert gain(edge) == pytest.approx(np.sqrt(0.5), abs=1e-6)


def test_T16_spectrogram(spark):
    x, sig = make(spark, 333)
    got = G.spectrogram(sig, 50.0, size=32, overlap=16, frames_per_block=3).orderBy("frame").collect()
    padded = np.pad(x, 16, mode="reflect")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    expected = []
    for start in range(0, len(padded) - 31, 16):
        piece = padded[start : start + 32]
        power = np.abs(np.fft.rfft((piece - piece.mean()) * window)) ** 2 / (50.0 * np.sum(window**2))
        power[1:-1] *= 2
        expected.append(20 * np.log10(power + np.finfo(float).eps))
    assert [r["frame"] for r in got] == list(range(len(expected)))
    assert np.allclose([r["power"] for r in got], expected, atol=1e-6)


@pytest.mark.parametrize("fs,target", [(50, 24), (50, 50)])
def test_T8_sinc(spark, fs, target):
    x, sig = make(spark, 400)
    got = [r["value"] for r in G.resample_sinc(sig, fs, target, block=61).orderBy("t").collect()]
    whole = kernels.sinc_resample(x, 0, 0, len(x) * target // fs, fs, target)
    assert len(got) == len(x) * target // fs and np.allclose(got, whole, atol=1e-12)


def test_T8_sinc_keeps_a_slow_wave(spark):
    t = np.arange(2000)
    rows = [(1, "i", int(i), float(np.sin(2 * np.pi * i / 100))) for i in t]
    sig = spark.createDataFrame(rows, "record_id int, channel string, t int, value double")
    got = {r["t"]: r["value"] for r in G.resample_sinc(sig, 500, 250).collect()}
    assert all(abs(got[j] - np.sin(2 * np.pi * 2 * j / 100)) < 1e-3 for j in range(200, 800))


def test_T17_noise_is_repeatable(spark):
    _, sig = make(spark, 4000)
    draw = lambda seed: [r["n"] for r in sig.select("t", (G.gaussian_noise("value", 0.5, seed) - sig["value"]).alias("n")).orderBy("t").collect()]
    a = draw(1)
    assert a == draw(1) and a != draw(2)
    assert abs(np.mean(a)) < 0.05 and np.std(a) == pytest.approx(0.5, abs=0.05)


def test_T14_skip(spark):
    _, sig = make(spark, 50)
    assert G.normalise_record(sig, skip=["i"]).exceptAll(sig.select("record_id", "channel", "t", "value")).count() == 0
