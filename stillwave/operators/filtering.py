"""Rate conversion and zero-phase filtering on overlapping chunks of a signal.

A chunk brings enough neighbouring samples for its own rows to come out as if
the whole signal had been processed: the kernel length for resampling, the
decay time of the slowest pole for the recursive filter. Chunks of one
recording run in different tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stillwave.operators.chunked import CHUNK, div

AXES = ("y", "x", "z")


def _overlapping(signal: DataFrame, keys: Sequence[str], idx: str, columns: Sequence[str], chunk_rows: int, margin: int) -> DataFrame:
    """Rows copied to every chunk within ``margin`` rows of them."""
    low = div(F.greatest(F.col(idx) - margin, F.lit(0)), chunk_rows)
    high = div(F.col(idx) + margin, chunk_rows)
    return signal.select(*keys, F.col(idx).alias("_i"), *[F.col(c).cast("double").alias(c) for c in columns],
                         F.explode(F.sequence(low, high)).alias(CHUNK))


def _in_pandas(step):
    """A step on the data frame of a chunk as a step on its Arrow table, which costs less for each of very many chunks."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = step(tuple(k.as_py() for k in key), pd.DataFrame({c: rows.column(c).to_numpy() for c in rows.column_names}))
        types = {c: rows.schema.field(c).type if c in rows.column_names else pa.int64() for c in out.columns}
        return pa.table({c: pa.array(out[c].to_numpy(), types[c], from_pandas=True) for c in out.columns})
    return run


def _end_in_sight(position: np.ndarray, chunk: int, chunk_rows: int, margin: int) -> int | None:
    """Last index of the subject when it lies before the end of the chunk's margin."""
    last = int(position.max())
    return last if last < (chunk + 1) * chunk_rows + margin - 1 else None


def resample(
    signal: DataFrame, from_hz: int, to_hz: int, columns: Sequence[str] = AXES, idx: str = "idx",
    keys: Sequence[str] = ("subject",), zeros: int = 32, chunk_secs: int = 600,
) -> DataFrame:
    """Band-limited conversion to ``to_hz``; output holds whole seconds only.

    Hann-windowed sinc interpolation with ``zeros`` zero crossings per side,
    the cut-off at the lower of the two Nyquist rates. Samples beyond the ends
    count as zero, as in a finite recording.
    """
    step = gcd(from_hz, to_hz)
    up, down = to_hz // step, from_hz // step
    scale = min(1.0, to_hz / from_hz)
    half = int(np.ceil(zeros / scale))
    chunk_rows = chunk_secs * from_hz
    out_rows = chunk_secs * to_hz
    columns = list(columns)
    # Outputs have one of ``up`` phases, so a tap has as many weights.
    weights = []
    for k in range(-half, half + 2):
        x = (k - np.arange(up) / up) * scale
        weights.append(np.where(np.abs(x) <= zeros, np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / zeros)), 0.0) * scale)

    def convert(key, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[-1])
        last = _end_in_sight(pdf["_i"].to_numpy(), chunk, chunk_rows, half + 2)
        first_out = chunk * out_rows
        stop_out = first_out + out_rows
        outs = np.arange(first_out, stop_out if last is None else min(stop_out, (last + 1) // from_hz * to_hz))
        base = chunk * chunk_rows - half - 2
        values = np.zeros((chunk_rows + 2 * half + 5, len(columns)))
        values[pdf["_i"].to_numpy() - base] = pdf[columns].to_numpy()
        centre = outs * down // up
        phase = outs * down % up
        result = np.zeros((len(outs), len(columns)))
        for k, weight in zip(range(-half, half + 2), weights):
            result += weight[phase][:, None] * values[centre + k - base]
        frame = pd.DataFrame(result, columns=columns)
        frame.insert(0, idx, outs)
        for name, value in zip(keys, key):
            frame[name] = value
        return frame[[*keys, idx, *columns]]

    types = dict(signal.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{idx} bigint"] + [f"{c} double" for c in columns])
    rows = _overlapping(signal, keys, idx, columns, chunk_rows, half + 2)
    return rows.groupBy(*keys, CHUNK).applyInArrow(_in_pandas(convert), schema)


def butterworth_sections(order: int, low: float, high: float, hz: float) -> np.ndarray:
    """Band-pass sections ``(b0, b1, b2, a1, a2)`` by the bilinear transform.

    Analog prototype poles on the unit circle, moved to the band with
    pre-warped edges; each digital section pairs a pole with its conjugate
    and has zeros at 0 and at the Nyquist rate.
    """
    edges = 2 * hz * np.tan(np.pi * np.array([low, high]) / hz)
    width, centre2 = edges[1] - edges[0], edges[0] * edges[1]
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    shifted = np.exp(1j * angles) * width / 2
    root = np.sqrt(shifted ** 2 - centre2 + 0j)
    poles = np.concatenate([shifted + root, shifted - root])
    digital = (2 * hz + poles) / (2 * hz - poles)
    upper = digital[digital.imag > 1e-14]
    real = np.sort(digital[np.abs(digital.imag) <= 1e-14].real)
    pairs = [(p, p.conj()) for p in upper] + [(complex(a), complex(b)) for a, b in zip(real[::2], real[1::2])]
    sections = np.array([[1.0, 0.0, -1.0, -(p + q).real, (p * q).real] for p, q in pairs])
    z = np.exp(1j * 2 * np.arctan(np.sqrt(centre2) / (2 * hz)))
    for s in sections:
        gain = abs((1 - z ** -2) / (1 + s[3] / z + s[4] / z ** 2))
        s[:3] /= gain
    return sections


def _transfer(sections: np.ndarray, size: int) -> np.ndarray:
    """Transfer function of the cascade at the frequencies of a transform of ``size`` rows."""
    w = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    transfer = np.ones_like(w)
    for b0, b1, b2, a1, a2 in sections:
        transfer *= (b0 + w * (b1 + w * b2)) / (1 + w * (a1 + w * a2))
    return transfer


def _respond(sections: np.ndarray, x: np.ndarray, settle: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Response of the cascade to rows of ``x`` that start from rest at their first value.

    A band-pass ignores a constant, so that value is taken off first. The
    transfer function is applied in the frequency domain, zero-padded by the
    settling time so that the end does not wrap around to the start.
    """
    n = len(x)
    size = 1 << int(np.ceil(np.log2(n + settle)))
    if size not in known:  # chunks of a task have the same few sizes
        known[size] = _transfer(sections, size)
    transfer = known[size]
    spectrum = np.fft.rfft(x - x[0], size, axis=0)
    return np.fft.irfft(spectrum * transfer[:, None], size, axis=0)[:n]


def settling_rows(sections: np.ndarray, tolerance: float = 1e-9) -> int:
    """Rows after which the response to an old state is below ``tolerance``."""
    slowest = max(np.abs(np.roots([1.0, s[3], s[4]])).max() for s in sections)
    return int(np.ceil(np.log(tolerance) / np.log(slowest)))


def butterworth_bandpass(
    signal: DataFrame, low: float, high: float, hz: int, order: int = 4, columns: Sequence[str] = AXES, idx: str = "idx",
    keys: Sequence[str] = ("subject",), chunk_rows: int | None = None, tolerance: float = 1e-9,
) -> DataFrame:
    """Forward-backward Butterworth band-pass per column, odd reflection at the two ends.

    The margin of a chunk is the settling time of the filter, so its rows
    differ from a run over the whole signal by less than ``tolerance`` of the
    signal's size.
    """
    sections = butterworth_sections(order, low, high, hz)
    margin = settling_rows(sections, tolerance)
    pad = 3 * (2 * order + 1)
    rows_per_chunk = chunk_rows or max(4 * margin, 65_536)
    columns = list(columns)

    known: dict[int, np.ndarray] = {}

    def apply(key, pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(key[-1])
        pdf = pdf.sort_values("_i")
        position = pdf["_i"].to_numpy()
        last = _end_in_sight(position, chunk, rows_per_chunk, margin)
        x = pdf[columns].to_numpy()
        edge = min(pad, len(x) - 1)
        before = 2 * x[0] - x[edge:0:-1] if position[0] == 0 else x[:0]
        after = 2 * x[-1] - x[-2:-edge - 2:-1] if position[-1] == last else x[:0]
        y = np.concatenate([before, x, after])
        y = _respond(sections, y, margin, known)
        y = _respond(sections, y[::-1], margin, known)[::-1]
        y = y[len(before):len(before) + len(x)]
        own = position // rows_per_chunk == chunk
        frame = pd.DataFrame(y[own], columns=columns)
        frame.insert(0, idx, position[own])
        for name, value in zip(keys, key):
            frame[name] = value
        return frame[[*keys, idx, *columns]]

    types = dict(signal.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{idx} bigint"] + [f"{c} double" for c in columns])
    rows = _overlapping(signal, keys, idx, columns, rows_per_chunk, margin)
    return rows.groupBy(*keys, CHUNK).applyInArrow(_in_pandas(apply), schema)
