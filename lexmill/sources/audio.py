"""WAV decoding on bytes: durations from headers, mono samples, errors as values."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DecodeError(ValueError):
    """Bytes that aren't PCM WAV [G5]."""


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, offset of samples, bytes of samples) of a RIFF file [S13]."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise DecodeError("not a RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            form = (kind, channels, rate, bits)
        elif name == b"data":
            if form is None or not form[1] or not form[2] or not form[3]:
                raise DecodeError("samples before their format")
            return *form, at + 8, size
        at += 8 + size + size % 2
    raise DecodeError("no samples")


def duration(data: bytes) -> float:
    """Seconds by the header alone [S13]."""
    _, channels, rate, bits, _, size = header(data)
    return size / (channels * bits // 8) / rate


def decode(data: bytes, rate: int | None = None, mono: bool = True) -> tuple[np.ndarray, int]:
    """Float samples and their rate; channels are averaged, another rate is reached by linear interpolation [S11, S12]."""
    kind, channels, own, bits, at, size = header(data)
    raw = data[at : at + size]
    if kind == 3 and bits == 32:
        x = np.frombuffer(raw[: len(raw) // 4 * 4], "<f4").astype(np.float32)
    elif kind in (1, 0xFFFE) and bits == 16:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768
    elif kind in (1, 0xFFFE) and bits == 32:
        x = np.frombuffer(raw[: len(raw) // 4 * 4], "<i4").astype(np.float32) / 2147483648
    elif kind in (1, 0xFFFE) and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    else:
        raise DecodeError(f"format {kind} with {bits} bits")
    x = x[: len(x) // channels * channels].reshape(-1, channels)
    x = x.mean(axis=1) if mono else x.T
    if rate and rate != own and mono and len(x):
        n = int(round(len(x) * rate / own))
        x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x, rate or own


def encode(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV [S43]."""
    body = (np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes()
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()


def durations(df: DataFrame, content: str = "content", given: str | None = None) -> DataFrame:
    """Adds ``seconds``: a given column, else the header; 0 for what can't be read [S5, P2]."""

    @F.pandas_udf("double")
    def seconds(data: pd.Series) -> pd.Series:
        def one(b):
            try:
                return 0.0 if b is None else duration(b)
            except (DecodeError, struct.error):
                return 0.0

        return data.map(one)

    found: Column = seconds(F.col(content))
    return df.withColumn("seconds", F.when(F.col(given).isNotNull(), F.col(given).cast("double")).otherwise(found) if given else found)


def decoded(df: DataFrame, content: str = "content", rate: int = 16000) -> DataFrame:
    """Adds ``clip``: samples, peak and seconds, or the error of a row that fails [S11, S12, S43, S44]."""

    @F.pandas_udf("samples array<float>, peak float, seconds double, error string")
    def clip(data: pd.Series) -> pd.DataFrame:
        rows = []
        for b in data:
            try:
                if b is None:
                    raise DecodeError("no audio")
                x, r = decode(b, rate)
                rows.append((x, float(np.abs(x).max(initial=0)), len(x) / r, None))
            except (DecodeError, struct.error) as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["samples", "peak", "seconds", "error"])

    return df.withColumn("clip", clip(F.col(content)))
