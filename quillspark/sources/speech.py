"""Audio and video: segments of a speech recognizer as sections.

Register with `files.register(".mp3", speech.reader(recognizer))` and the like.
A recognizer is a function from the path of an audio file to segments (text,
start, end, and confidence if known). Video is first turned into mono sound of
16 kHz by ffmpeg, which must be installed where it is needed.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterable, Iterator

from quillspark.functions.text import MEDIA_SUFFIXES
from quillspark.operators.transcript import merge_segments

Recognizer = Callable[[str], Iterable[dict]]
#: Suffixes that hold pictures; .webm is taken for sound.
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".avi")
AUDIO_SUFFIXES = tuple(s for s in MEDIA_SUFFIXES if s not in VIDEO_SUFFIXES)


def sections(segments: Iterable[dict], merge: bool = False, most_words: int = 120, most_seconds: float = 90.0, most_gap: float = 8.0) -> list[dict]:
    """Sections of segments that hold text, with times to hundredths of a second; merged if asked."""
    rows = []
    for own in segments:
        text = " ".join((own.get("text") or "").split())
        if text:
            start, end = (None if own.get(k) is None else round(float(own[k]), 2) for k in ("start", "end"))
            rows.append({"index": len(rows), "text": text, "raw_text": text, "start_time_s": start, "end_time_s": end, "speaker": own.get("speaker"), "confidence": own.get("confidence"), "extraction_method": "asr"})
    return merge_segments(rows, most_words, most_seconds, most_gap) if merge else rows


def sound_of(path: str, out: str) -> None:
    """Write the sound of a video as mono wav of 16 kHz."""
    if not shutil.which("ffmpeg"):
        raise RuntimeError(f"{path}: video needs ffmpeg")
    subprocess.run(["ffmpeg", "-y", "-i", path, "-vn", "-ac", "1", "-ar", "16000", out], check=True, capture_output=True)


def reader(recognizer: Recognizer, merge: bool = False):
    """A reader for `files.register`; a file's bytes are held by the task that reads it."""

    def read_media(path: str, content: bytes) -> Iterator[dict]:
        suffix = path[path.rindex(".") :].lower()
        with tempfile.TemporaryDirectory() as folder:  # of this task alone
            here = os.path.join(folder, f"media{suffix}")
            with open(here, "wb") as out:
                out.write(content)
            if suffix in VIDEO_SUFFIXES:
                sound_of(here, os.path.join(folder, "sound.wav"))
                here = os.path.join(folder, "sound.wav")
            yield from sections(recognizer(here), merge)

    return read_media
