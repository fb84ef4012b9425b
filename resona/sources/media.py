"""WAV and MIDI files: readers over ``binaryFile`` tables, and writers of one binary value a track."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Uploads over this many bytes are refused.
LARGEST = 512 << 20


class TooLarge(ValueError):
    """A file of more than LARGEST bytes."""


class UnsupportedFormat(ValueError):
    """The bytes are of a format that this engine does not decode."""


def pcm16(samples: np.ndarray) -> bytes:
    """Little-endian 16-bit samples, clipped to [-1, 1]."""
    return (np.clip(samples, -1.0, 1.0) * 32767).astype("<i2").tobytes()


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono file for one dimension, else (sample, channel)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(pcm16(samples))
    return out.getvalue()


def wav_samples(data: bytes, start: float = 0.0, end: float | None = None) -> tuple[np.ndarray, int]:
    """(sample, channel) values in [-1, 1) of a slice in seconds, and the rate."""
    try:
        f = wave.open(io.BytesIO(data))
    except (wave.Error, EOFError) as e:
        raise UnsupportedFormat(str(e)) from e
    with f:
        rate, width, channels, total = f.getframerate(), f.getsampwidth(), f.getnchannels(), f.getnframes()
        a, b = int(start * rate), total if end is None else min(int(end * rate), total)
        if a >= total:
            raise ValueError("the slice begins after the end")
        f.setpos(a)
        raw = f.readframes(b - a)
    if width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((wide[:, 0] << 8 | wide[:, 1] << 16 | wide[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        values = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return values.reshape(-1, channels), rate


def read_wav(spark: SparkSession, path: str, start: float = 0.0, end: float | None = None) -> DataFrame:
    """(track, ch, n, v, rate) of the files under a path; TooLarge if any of them is, even for a slice."""
    found = spark.read.format("binaryFile").load(path)
    # only names and sizes are read here
    if large := found.where(F.col("length") > LARGEST).select("path", "length").first():
        raise TooLarge(f"{large.path} has {large.length} bytes, the most is {LARGEST}")
    files = found.select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                values, rate = wav_samples(content, start, end)
                for ch in range(values.shape[1]):
                    for a in range(0, len(values), 1 << 16):
                        part = values[a : a + (1 << 16), ch]
                        yield pd.DataFrame({"track": name, "ch": ch, "n": np.arange(a, a + len(part)), "v": part, "rate": rate})

    return files.mapInPandas(run, "track string, ch int, n long, v double, rate int")


def _number(n: int) -> bytes:
    """A MIDI variable-length number, which has 28 bits at most."""
    if n >= 1 << 28:
        raise ValueError(f"{n} ticks from one event to the next are more than a file can say")
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack(">I", len(body)) + body


def midi_bytes(tracks: dict[str, list[tuple[int, int, int, int]]], bpm: float) -> bytes:
    """A standard MIDI file of tracks of (delta, kind, pitch, velocity): type 0 for one track, else a conductor and the tracks."""
    if not tracks:
        raise ValueError("there is no track to write")
    tempo = b"\0\xff\x51\x03" + round(60_000_000 / bpm).to_bytes(3, "big")
    end = b"\0\xff\x2f\0"
    bodies = []
    for name, events in tracks.items():
        label = name.encode()
        body = b"\0\xff\x03" + _number(len(label)) + label
        for delta, kind, pitch, velocity in events:
            body += _number(delta) + bytes([0x90 if kind else 0x80, pitch, velocity])
        bodies.append(body)
    bodies = [tempo + bodies[0]] if len(bodies) == 1 else [tempo, *bodies]
    header = struct.pack(">HHH", int(len(tracks) > 1), len(bodies), S.TICKS)
    return _chunk(b"MThd", header) + b"".join(_chunk(b"MTrk", b + end) for b in bodies)


def midi_notes(data: bytes) -> list[tuple[int, float, float]]:
    """Sorted (pitch, start, end) of a file's notes, at the first tempo of its first track.

    An off ends all notes of its pitch that are open in the track; a note that nothing ends is none.
    """
    if data[:4] != b"MThd":
        raise UnsupportedFormat("no MIDI file")
    division, at, tempo, raw, n_tracks = struct.unpack(">H", data[12:14])[0], 14, None, [], 0
    while at + 8 <= len(data):
        end = at + 8 + struct.unpack(">I", data[at + 4 : at + 8])[0]
        if data[at : at + 4] != b"MTrk":
            at = end
            continue
        n_tracks += 1
        i, tick, status, open_ = at + 8, 0, 0, {}
        while i < end:
            delta = 0
            while True:
                delta = delta << 7 | data[i] & 0x7F
                i += 1
                if not data[i - 1] & 0x80:
                    break
            tick += delta
            if data[i] & 0x80:
                status = data[i]
                i += 1
            if status in (0xFF, 0xF0, 0xF7):
                kind = data[i] if status == 0xFF else None
                i += status == 0xFF
                size = 0
                while True:
                    size = size << 7 | data[i] & 0x7F
                    i += 1
                    if not data[i - 1] & 0x80:
                        break
                if kind == 0x51 and tempo is None and n_tracks == 1:
                    tempo = int.from_bytes(data[i : i + size], "big")
                i += size
                continue
            size = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
            pitch, velocity = data[i], data[i + 1] if size == 2 else 0
            i += size
            if status & 0xF0 == 0x90 and velocity:
                open_.setdefault(pitch, []).append(tick)
            elif status & 0xE0 == 0x80:
                raw += [(pitch, on, tick) for on in open_.pop(pitch, [])]
        at = end
    second = (tempo or 500_000) / 1e6 / division
    return sorted((p, a * second, b * second) for p, a, b in raw)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    """(track, pitch, start, end) of the notes of the files under a path."""
    return notes_of(spark.read.format("binaryFile").load(path).select("path", "content")).drop("id")


def notes_of(files: DataFrame) -> DataFrame:
    """(track, pitch, start, end, id) of MIDI files (path, content); ids number a file's notes by pitch, start and end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(midi_notes(content), columns=["pitch", "start", "end"])
                yield found.assign(track=name, id=np.arange(len(found)))[["track", "pitch", "start", "end", "id"]]

    return files.mapInPandas(run, "track string, pitch int, start double, end double, id long")


def one_midi(deltas: DataFrame, by: str, bpm: float) -> DataFrame:
    """(by, content): a MIDI file for each value of a column, from rows (by, track, tick, kind, pitch, velocity, delta, id)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = part.sort_values(["track", "tick", "kind", "id"])
        tracks = {str(n): list(zip(t["delta"].tolist(), t["kind"].tolist(), t["pitch"].tolist(), t["velocity"].tolist(), strict=True)) for n, t in held.groupby("track", sort=True)}
        return pd.DataFrame({by: [part[by].iloc[0]], "content": [midi_bytes(tracks, bpm)]})

    return deltas.groupBy(by).applyInPandas(run, deltas.select(by).schema.add("content", "binary"))
