"""Where outside models plug in: speech recognition, diarization, alignment, speech detection, parsing, denoising.

A model is a callable that is built once in each worker and gets one sound at a
time.  A sound that it can't take, or a model that isn't there, is an error row
and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxtide.sources.wav import RATE, AudioError, _mono, resample

# What each kind of model gives for a sound.
OUTPUTS = {
    "asr": "segment_no int, start_ms long, end_ms long, text string",
    "diarizer": "start_ms long, end_ms long, cluster_id string",
    "detector": "start_ms long, end_ms long",
    "aligner": "word_no int, word string, start_ms long, end_ms long",
    "denoiser": "samples array<float>",
}


class Model(Protocol):
    def __call__(self, samples: np.ndarray, rate: int) -> list[Mapping[str, Any]]: ...


_registry: dict[tuple[str, str], Callable[[], Model]] = {}


def register(kind: str, name: str, build: Callable[[], Model]) -> None:
    """``build`` makes the model in a worker; it may raise ImportError where its packages are missing."""
    if kind not in OUTPUTS:
        raise ValueError(f"unknown kind of model: {kind}")
    _registry[kind, name] = build


def run(kind: str, name: str, files: DataFrame, channel: int | None = None) -> DataFrame:
    """(path, the columns of the kind, error_code) for each sound of (path, content)."""
    build = _registry.get((kind, name))
    schema = T._parse_datatype_string(f"path string, {OUTPUTS[kind]}, error_code string")
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            model = build() if build is not None else None
        except ImportError:
            model = None
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if model is None:
                    rows = [{"path": path, "error_code": "MODEL_UNAVAILABLE"}]
                else:
                    try:
                        x, rate, _, _ = _mono(content, channel)
                        rows = [{"path": path, **r} for r in model(resample(x, rate).astype(np.float32), RATE)]
                    except AudioError as e:
                        rows = [{"path": path, "error_code": e.code}]
                    except Exception:  # whatever a model raises concerns this sound only
                        rows = [{"path": path, "error_code": "MODEL_FAILED"}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "content").mapInArrow(apply, schema)


def energy_detector(frame: int = 400, hop: int = 160, least_ms: int = 150) -> Model:
    """A plain speech detector: frames whose energy is above the mean of the frames that aren't silent."""

    def detect(x: np.ndarray, rate: int) -> list[Mapping[str, Any]]:
        if len(x) < frame:
            return []
        e = np.square(np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), frame)[::hop]).sum(1)
        loud = e > 1e-6
        on = np.concatenate([[False], loud & (e >= 0.25 * e[loud].mean()) if loud.any() else loud, [False]])
        edges = np.flatnonzero(on[1:] != on[:-1])
        spans = [(a * hop * 1000 // rate, ((b - 1) * hop + frame) * 1000 // rate) for a, b in zip(edges[::2], edges[1::2])]
        return [{"start_ms": int(a), "end_ms": int(b)} for a, b in spans if b - a >= least_ms]

    return detect


register("detector", "energy", energy_detector)
