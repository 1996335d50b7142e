"""File sources and sinks: annotation CSV, WAV, MIDI and MusicXML.

Binary files are read by Spark's ``binaryFile`` source and decoded in Arrow batches, so any store
that Spark reads will do; a file is one task.  WAV is PCM of 8, 16, 24 or 32 bits or float.
"""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import wave
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only where that is unset below a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tonalis-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ";", label: str | None = None) -> DataFrame:
    """A CSV with empty strings kept; optionally a constant label column, which must not exist yet."""
    df = spark.read.schema(schema).option("sep", sep).option("header", header).option("emptyValue", "").option("nullValue", "\u0000").csv(path)
    if label is None:
        return df
    if "label" in df.columns:
        raise ValueError("there is a column label already")
    return df.withColumn("label", F.lit(label))


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ";", decimals: int | None = None) -> None:
    """A CSV whose strings are quoted and numbers are not; ``decimals`` formats doubles."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    out = []
    for c, kind in df.dtypes:
        out.append(quoted(c) if kind == "string" else F.format_number(c, decimals) if kind == "double" and decimals is not None else F.col(c).cast("string"))
    names = [f'"{c}"' for c in df.columns]
    line = F.concat_ws(sep, *[F.coalesce(x, F.lit("")) for x in out])
    rows = df.select(line.alias("value"))
    if header:
        first = df.sparkSession.createDataFrame([(sep.join(names),)], "value string")
        rows = first.coalesce(1).union(rows)
    rows.write.mode("overwrite").text(path)


def read_structure(spark: SparkSession, path: str, Fs: float = 1, remove_digits: bool = False, index: bool = False, track: str = "t0") -> DataFrame:
    from ..operators.symbolic import convert_structure

    df = read_csv(spark, path, "start double, end double, label string").withColumn("track_id", F.lit(track))
    return convert_structure(df, Fs, remove_digits, index).select("track_id", "start", "end", "label")


def read_positions(spark: SparkSession, path: str, label: str = "", header: bool = True, labelled: bool = False, track: str = "t0") -> DataFrame:
    df = read_csv(spark, path, "pos double, label string" if labelled else "pos double", header)
    df = df if labelled else df.withColumn("label", F.lit(label))
    return df.select(F.lit(track).alias("track_id"), "pos", "label")


def read_notes(spark: SparkSession, path: str, track: str = "t0") -> DataFrame:
    df = read_csv(spark, path, "start double, duration double, pitch double, velocity double, label string")
    return df.select(F.lit(track).alias("track_id"), *df.columns)


def write_notes(notes: DataFrame, path: str) -> None:
    names = ["Start", "Duration", "Pitch", "Velocity", "Instrument"]
    write_csv(notes.select("start", "duration", "pitch", "velocity", "label").toDF(*names), path, decimals=3)


def read_cut_notes(spark: SparkSession, path: str, start_sec: float, end_sec: float, track: str = "t0") -> DataFrame:
    """Notes of a time range from a header-less comma file (start, end, pitch, label)."""
    from ..operators.symbolic import cut_notes

    df = read_csv(spark, path, "start double, end double, pitch double, label double", header=False, sep=",")
    return cut_notes(df.withColumn("track_id", F.lit(track)), start_sec, end_sec)


# ---------------------------------------------------------------- WAV


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples by channels in [-1, 1], and the rate."""
    if data[:4] == b"RIFF" and _format_tag(data) == 3:
        return _float_wav(data)
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def _chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def _format_tag(data: bytes) -> int:
    return next((struct.unpack_from("<H", data, at)[0] for name, at, _ in _chunks(data) if name == b"fmt "), 1)


def _float_wav(data: bytes) -> tuple[np.ndarray, int]:
    for name, at, size in _chunks(data):
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at)
        elif name == b"data":
            return np.frombuffer(data, f"<f{bits // 8}", size // (bits // 8), at).astype(float).reshape(-1, channels), rate
    raise ValueError("no samples in the file")


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit PCM; samples beyond [-1, 1] are clipped."""
    x = np.atleast_2d(np.asarray(x, float).T).T
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling of one channel by its spectrum."""
    if rate == target or not len(x):
        return x
    size = max(1, int(round(len(x) * target / rate)))
    X = np.fft.rfft(x)
    Y = np.zeros(size // 2 + 1, complex)
    k = min(len(X), len(Y))
    Y[:k] = X[:k]
    return np.fft.irfft(Y, size) * (size / len(x))


def read_audio(spark: SparkSession, path: str, Fs: int | None = None, mono: bool = False, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """Signals of WAV files: track_id (the path), channel, n, x, Fs.

    ``offset`` and ``duration`` in seconds keep only that range, before resampling.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                x, rate = decode_wav(data)
                x = x[int(offset * rate) : None if duration is None else int((offset + duration) * rate)]
                x = x.mean(1, keepdims=True) if mono else x
                for c in range(x.shape[1]):
                    y = resample(x[:, c], rate, Fs) if Fs else x[:, c]
                    for at in range(0, len(y), 1 << 18):
                        part = y[at : at + (1 << 18)]
                        yield pd.DataFrame({"track_id": name, "channel": c, "n": np.arange(at, at + len(part)), "x": part, "Fs": Fs or rate})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "track_id string, channel int, n long, x double, Fs int")


def audio_files(signal: DataFrame, Fs: int) -> DataFrame:
    """A WAV file of each track's signal: track_id, content.  Write it with any sink for binary rows."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]], "content": [encode_wav(pdf.sort_values("n")["x"].to_numpy(), Fs)]})

    return signal.select("track_id", "n", "x").groupBy("track_id").applyInPandas(encode, "track_id string, content binary")


def write_audio(signal: DataFrame, folder: str, Fs: int) -> DataFrame:
    """Write a WAV file per track below a folder or URI that executors share; returns track_id, path, bytes."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            rows = []
            for track, data in zip(pdf["track_id"], pdf["content"], strict=True):
                name = f"{root}/{''.join(c if c.isalnum() else '_' for c in str(track))}.wav"
                with store.open_output_stream(name) as f:
                    f.write(data)
                rows.append((track, name, len(data)))
            yield pd.DataFrame(rows, columns=["track_id", "path", "bytes"])

    return audio_files(signal, Fs).mapInPandas(write, "track_id string, path string, bytes long")


# ---------------------------------------------------------------- MIDI


def parse_midi(data: bytes) -> list[tuple[float, float, float, float, str]]:
    """Notes (start, duration, pitch, velocity, instrument) of a standard MIDI file, times in seconds."""
    if data[:4] != b"MThd":
        raise ValueError("not a MIDI file")
    size, _, tracks, division = struct.unpack_from(">IHHH", data, 4)
    at, tempo, events = 8 + size, [(0, 500000)], []
    for track in range(tracks):
        length = struct.unpack_from(">I", data, at + 4)[0]
        at, end = at + 8, at + 8 + length
        tick, status, name, order = 0, 0, "", 0
        while at < end:
            delta, at = _varlen(data, at)
            tick += delta
            if data[at] & 0x80:
                status = data[at]
                at += 1
            if status == 0xFF:
                kind = data[at]
                n, at = _varlen(data, at + 1)
                if kind == 0x51:
                    tempo.append((tick, int.from_bytes(data[at : at + 3], "big")))
                elif kind == 0x03:
                    name = data[at : at + n].decode("latin-1")
                at += n
            elif status in (0xF0, 0xF7):
                n, at = _varlen(data, at)
                at += n
            else:
                kind, channel = status & 0xF0, status & 0x0F
                if kind in (0x80, 0x90):
                    on = kind == 0x90 and data[at + 1] > 0
                    events.append((tick, on, track, channel, data[at], data[at + 1], name, order))
                    order += 1
                at += 1 if kind in (0xC0, 0xD0) else 2
        at = end
    tempo.sort()
    ticks, seconds = [0], [0.0]
    for (t0, us), (t1, _) in zip(tempo, tempo[1:]):  # noqa: B905
        ticks.append(t1)
        seconds.append(seconds[-1] + (t1 - t0) * us / 1e6 / division)

    def time(tick: int) -> float:
        i = int(np.searchsorted(ticks, tick, side="right")) - 1
        return seconds[i] + (tick - ticks[i]) * tempo[i][1] / 1e6 / division

    sounding: dict[tuple, list] = {}
    notes = []
    for tick, on, track, channel, pitch, velocity, name, _ in sorted(events, key=lambda e: (e[0], e[1])):
        key = (track, channel, pitch)
        if on:
            sounding.setdefault(key, []).append((tick, velocity, name))
        else:
            for start, v, label in sounding.pop(key, []):
                notes.append((time(start), time(tick) - time(start), float(pitch), v / 127.0, label))
    return sorted(notes, key=lambda n: (n[0], n[2]))


def _varlen(data: bytes, at: int) -> tuple[int, int]:
    out = 0
    while True:
        out = out << 7 | data[at] & 0x7F
        at += 1
        if not data[at - 1] & 0x80:
            return out, at


# ---------------------------------------------------------------- MusicXML

STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def parse_musicxml(data: bytes) -> list[tuple[float, float, float, float, str]]:
    """Notes (start, duration, pitch, velocity, part) in quarter notes, sorted by start and pitch.

    Compressed files are unpacked; velocity is the dynamics attribute over 90 or 0.7; ties stay
    separate notes; rests and grace notes give none.
    """
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(next(n for n in z.namelist() if n.endswith((".xml", ".musicxml")) and not n.startswith("META-INF")))
    root = ET.fromstring(data)
    names = {}
    for p in root.iter("score-part"):
        options = (p.findtext("part-name"), p.findtext("score-instrument/instrument-name"), p.findtext("part-abbreviation"))
        names[p.get("id")] = next((x for x in options if x), "Unknown")
    notes = []
    for part in root.iter("part"):
        now, last, divisions = 0.0, 0.0, 1.0
        for measure in part.iter("measure"):
            for e in measure:
                if e.tag == "attributes" and e.findtext("divisions"):
                    divisions = float(e.findtext("divisions"))
                elif e.tag in ("backup", "forward"):
                    now += float(e.findtext("duration")) / divisions * (-1 if e.tag == "backup" else 1)
                elif e.tag == "note" and e.find("grace") is None:
                    length = float(e.findtext("duration") or 0) / divisions
                    start = last if e.find("chord") is not None else now
                    pitch = e.find("pitch")
                    if pitch is not None:
                        midi = STEPS[pitch.findtext("step")] + float(pitch.findtext("alter") or 0) + 12 * (int(pitch.findtext("octave")) + 1)
                        dynamics = e.get("dynamics")
                        notes.append((start, length, midi, float(dynamics) / 90 if dynamics else 0.7, names.get(part.get("id"), "Unknown")))
                    if e.find("chord") is None:
                        last, now = now, now + length
    return sorted(notes, key=lambda n: (n[0], n[2]))


def _notes_of(spark: SparkSession, path: str, parse) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(parse(bytes(data)), columns=["start", "duration", "pitch", "velocity", "label"])
                out.insert(0, "track_id", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, schemas.NOTES)


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    return _notes_of(spark, path, parse_midi)


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    return _notes_of(spark, path, parse_musicxml)
