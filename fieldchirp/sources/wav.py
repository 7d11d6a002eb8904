"""WAV files as rows, and rows as WAV files, with the standard library's reader."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType

from fieldchirp.operators.clips import split_samples

SCHEMA = "path string, channel int, sample_rate int, n_channels int, duration double, samples array<float>, error string"


def decode(content: bytes, offset: float = 0.0, duration: float | None = None) -> tuple[np.ndarray, int]:
    """(channels x samples in [-1, 1], rate) of a slice; only the slice's frames are converted."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, ch = w.getframerate(), w.getsampwidth(), w.getnchannels()
        start = min(max(int(offset * rate), 0), w.getnframes())
        n = w.getnframes() - start if duration is None else min(int(duration * rate), w.getnframes() - start)
        w.setpos(start)
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 2**15
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - ((v & 0x800000) << 1)).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    return x.reshape(-1, ch).T, rate


# Tags of the INFO chunk by the names they have here.
TAGS = {"title": b"INAM", "artist": b"IART", "comment": b"ICMT", "copyright": b"ICOP", "software": b"ISFT", "album": b"IPRD", "date": b"ICRD", "genre": b"IGNR", "tracknumber": b"ITRK", "engineer": b"IENG"}


def with_tags(data: bytes, tags: dict[str, str]) -> bytes:
    """A WAV file with its INFO chunk set; an empty tag becomes a single blank."""
    body = b""
    for name, value in tags.items():
        raw = (value or " ").encode() + b"\0"
        body += TAGS[name] + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    kept = [(k, c) for k, c in _chunks(data) if not (k == b"LIST" and c[:4] == b"INFO")]
    out = b"WAVE" + b"".join(k + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for k, c in [*kept, (b"LIST", b"INFO" + body)])
    return b"RIFF" + struct.pack("<I", len(out)) + out


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise wave.Error("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def parse_tags(data: bytes) -> dict[str, str]:
    """Tags of a WAV file's INFO chunk, with samplerate, channels, duration and filesize; none of the former where there is no chunk."""
    names = {v: k for k, v in TAGS.items()}
    found: dict[str, str] = {}
    for key, body in _chunks(data):
        if key == b"LIST" and body[:4] == b"INFO":
            at = 4
            while at + 8 <= len(body):
                n = struct.unpack("<I", body[at + 4 : at + 8])[0]
                if body[at : at + 4] in names:
                    found[names[body[at : at + 4]]] = body[at + 8 : at + 8 + n].rstrip(b"\0").decode("utf-8", "replace")
                at += 8 + n + n % 2
    with wave.open(io.BytesIO(data)) as w:
        found |= {"samplerate": str(w.getframerate()), "channels": str(w.getnchannels()), "duration": repr(w.getnframes() / w.getframerate()), "filesize": str(len(data))}
    return found


@pandas_udf(MapType(StringType(), StringType()))
def wav_tags(content: pd.Series) -> pd.Series:
    """Tags of the bytes of WAV files; null for what isn't one."""

    def one(c):
        try:
            return None if c is None else parse_tags(c)
        except (wave.Error, EOFError, ValueError, struct.error):
            return None

    return content.map(one)


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit WAV of channels x samples."""
    buf = io.BytesIO()
    x = np.atleast_2d(x)
    with wave.open(buf, "wb") as w:
        w.setnchannels(x.shape[0])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x.T, -1, 1) * 32767).round().astype("<i2").tobytes())
    return buf.getvalue()


def read_wav(spark: SparkSession, path: str, mono: bool = True, offset: float = 0.0, duration: float | None = None) -> DataFrame:
    """Recordings as rows: one per file (mono, the mean) or per channel.  An unreadable file is a row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b.path, b.content, strict=True):
                try:
                    x, rate = decode(c, offset, duration)
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((p, None, None, None, None, None, str(e)[:200]))
                    continue
                n = len(x)
                for i, s in enumerate([x.mean(axis=0)] if mono else x):
                    rows.append((p, i, rate, n, x.shape[1] / rate, s.astype(np.float32), None))
            out = pd.DataFrame(rows, columns=["path", "channel", "sample_rate", "n_channels", "duration", "samples", "error"])
            yield out.astype({"channel": "Int32", "sample_rate": "Int32", "n_channels": "Int32"})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, SCHEMA)


def write_wav(df: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Write each row's samples to ``folder``/name; runs when the returned (path, n_bytes) is consumed.

    The folder must be one that all executors share; files appear whole or
    not at all, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for n, x, rate in zip(b[name], b.samples, b.sample_rate, strict=True):
                data = encode(np.asarray(x), int(rate))
                target = os.path.join(folder, n)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, target)
                rows.append((target, len(data)))
            yield pd.DataFrame(rows, columns=["path", "n_bytes"])

    return df.select(name, "samples", "sample_rate").mapInPandas(run, "path string, n_bytes long")


def split_and_save(df: DataFrame, folder: str, clip_duration: float, rate: int, prefix: str = "prefix", dry_run: bool = False, **grid) -> DataFrame:
    """Clips of recordings (prefix, samples) as files ``prefix_<start>s_<end>s.wav``: (path, start_time, end_time, n_bytes); with ``dry_run`` the table alone."""
    cut = split_samples(df.select(prefix, "samples"), rate, clip_duration, pad=grid.get("final_clip", "extend") == "extend", **grid)
    named = cut.withColumn("name", F.concat(F.col(prefix), F.lit("_"), F.col("start_time").cast("string"), F.lit("s_"), F.col("end_time").cast("string"), F.lit("s.wav")))
    path = F.concat(F.lit(folder.rstrip("/") + "/"), "name")
    if dry_run:
        return named.select(path.alias("path"), "start_time", "end_time")
    written = write_wav(named.withColumn("sample_rate", F.lit(rate)), folder)
    return named.select(path.alias("path"), "start_time", "end_time").join(written, "path")


def comment_metadata(comment: Column, prefix: str) -> Column:
    """JSON kept in a comment behind a prefix, as a map of strings; null without it."""
    return F.when(comment.startswith(prefix), F.from_json(F.substr(comment, F.lit(len(prefix) + 1)), "map<string,string>"))


def metadata_comment(metadata: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.to_json(metadata))


_AUDIOMOTH = r"Recorded at (\d{2}:\d{2}:\d{2}) (\d{2}/\d{2}/\d{4}) \(UTC([+-]\d+)?(?::?(\d{2}))?\)"


def audiomoth_start(comment: Column) -> Column:
    """Instant of recording from the comment that AudioMoth recorders write (day first, zone in hours)."""
    part = lambda i: F.regexp_extract(comment, _AUDIOMOTH, i)
    local = F.try_to_timestamp(F.concat_ws(" ", part(2), part(1)), F.lit("dd/MM/yyyy HH:mm:ss"))
    hours = F.coalesce(F.when(part(3) != "", part(3).cast("int")), F.lit(0))
    minutes = F.when(part(4) != "", part(4).cast("int")).otherwise(0) * F.when(part(3).startswith("-"), -1).otherwise(1)
    return F.timestamp_micros(F.unix_micros(local) - (hours * 3600 + minutes * 60).cast("long") * 1_000_000)


def device_of(artist: str) -> str | None:
    """Device id from an artist tag, driver-side helper."""
    m = re.fullmatch(r"AudioMoth\s+(\S+)", artist.strip())
    return m[1] if m else None


def metadata_json(d: dict) -> str:
    return json.dumps(d, sort_keys=True, default=str)
