"""Frames of videos through a decoder: a full scan of small frames, and one pass over the wanted frames.

A decoder takes a video's path and yields its frames in order, as (height, width, 3) arrays of bytes; it runs on the
executors, one video a time in each task, and is all that a deployment has to bring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[str], Iterator[np.ndarray]]
_FRAME = "frame_index long, width int, height int, data binary"
#: Frames that a task hands on at once.
_BATCH = 64


def resized(frame: np.ndarray, width: int, height: int) -> np.ndarray:
    """The frame at another size: the pixel at the middle of each new one."""
    y = (2 * np.arange(height) + 1) * frame.shape[0] // (2 * height)
    x = (2 * np.arange(width) + 1) * frame.shape[1] // (2 * width)
    return frame[y][:, x]


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _row(video: str, index: int, frame: np.ndarray) -> tuple:
    return video, index, frame.shape[1], frame.shape[0], np.ascontiguousarray(frame, np.uint8).tobytes()


_NAMES = ["video_id", "frame_index", "width", "height", "data"]


def small_frames(videos: DataFrame, decoder: Decoder, width: int = 48, height: int = 27) -> DataFrame:
    """All frames of (video_id, path), resized; frames are decoded as they are asked for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for video, path in zip(part["video_id"], part["path"], strict=True):
                yield from _batches((_row(video, i, resized(f, width, height)) for i, f in enumerate(decoder(path))), _NAMES)

    return videos.select("video_id", "path").mapInPandas(run, f"video_id string, {_FRAME}")


def wanted_frames(videos: DataFrame, wanted: DataFrame, decoder: Decoder, max_side: int | None = None) -> DataFrame:
    """The frames of (video_id, frame_index) in ``wanted``, in one pass a video that stops after the last of them.

    With ``max_side`` a frame whose longer side is more is scaled down to it.
    """

    def some(video: str, path: str, indices) -> Iterator[tuple]:
        left = set(indices)
        for i, f in enumerate(decoder(path)):
            if i in left:
                left.discard(i)
                scale = min(1.0, (max_side or max(f.shape[:2])) / max(f.shape[:2]))
                yield _row(video, i, f if scale == 1.0 else resized(f, max(1, int(f.shape[1] * scale)), max(1, int(f.shape[0] * scale))))
            if not left:
                return

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for video, path, indices in zip(part["video_id"], part["path"], part["indices"], strict=True):
                yield from _batches(some(video, path, indices), _NAMES)

    # A video has no more wanted frames than frames.
    each = wanted.groupBy("video_id").agg(F.collect_set("frame_index").alias("indices"))
    return videos.select("video_id", "path").join(each, "video_id").mapInPandas(run, f"video_id string, {_FRAME}")


def stand_in(frames: int = 200, width: int = 64, height: int = 36) -> Decoder:
    """A decoder without videos: pixel (y, x) of colour c in frame i is (i + 3 x + 5 y + 7 c + the path's length) modulo 256."""

    def decode(path: str) -> Iterator[np.ndarray]:
        y, x, c = np.ogrid[:height, :width, :3]
        for i in range(frames):
            yield ((i + 3 * x + 5 * y + 7 * c + len(path)) % 256).astype(np.uint8)

    return decode
