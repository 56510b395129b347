"""Audio and video conversions by an encoder of the host, where one is installed. The arguments are planned by
plain functions; a run gets files of its own in the task's folder, a time limit, and no shell."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from dataclasses import dataclass

from .walkers import Malformed

ENCODER = "ffmpeg"
#: Places looked at for tools beside PATH.
TOOL_FOLDERS = ("/usr/bin", "/usr/local/bin", "/opt/homebrew/bin")

# Encoder arguments of each target format.
AUDIO_CODECS = {
    "wav": ["-c:a", "pcm_s16le"],
    "mp3": ["-c:a", "libmp3lame", "-b:a", "192k"],
    "flac": ["-c:a", "flac"],
    "ogg": ["-c:a", "libvorbis", "-q:a", "5"],
    "aac": ["-c:a", "aac", "-b:a", "192k"],
}
VIDEO_CODECS = {
    "mp4": ["-c:v", "libx264", "-preset", "fast", "-crf", "{crf}", "-c:a", "aac", "-b:a", "160k"],
    "mov": ["-c:v", "libx264", "-preset", "fast", "-crf", "{crf}", "-c:a", "aac", "-b:a", "160k"],
    "webm": ["-c:v", "libvpx-vp9", "-crf", "{crf}", "-b:v", "0", "-c:a", "libopus", "-b:a", "128k"],
    "mkv": ["-c:v", "libx264", "-preset", "fast", "-crf", "{crf}", "-c:a", "aac"],
    "avi": ["-c:v", "mpeg4", "-q:v", "4", "-c:a", "mp3"],
}
DEFAULT_CRF = {"webm": 30}
LOUDNESS = "loudnorm=I=-16:TP=-1.5:LRA=11"
PALETTE = "split[s0][s1];[s0]palettegen[p];[s1][p]paletteuse"


@dataclass(frozen=True)
class Options:
    """What a conversion changes; fields that don't belong to its target are not looked at."""

    rate: int | None = None
    channels: int | None = None
    gain: float | None = None
    normalize: bool = False
    size: tuple[int, int] | None = None
    fps: float | None = None
    crf: int | None = None
    copy: bool = False
    faststart: bool = True


def find_tool(name: str) -> str | None:
    """Where a tool is on this machine: the usual folders, then PATH."""
    usual = (f"{d}/{name}" for d in TOOL_FOLDERS)
    return next((p for p in usual if os.access(p, os.X_OK)), None) or shutil.which(name)


def audio_arguments(target: str, o: Options) -> list[str]:
    """Sound only, whatever the source holds."""
    filters = [f"volume={o.gain:.2f}"] if o.gain is not None else []
    filters += [LOUDNESS] if o.normalize else []
    pairs = (("-ar", o.rate), ("-ac", o.channels), ("-filter:a", ",".join(filters) or None))
    return ["-vn", *AUDIO_CODECS[target], *(x for flag, value in pairs if value is not None for x in (flag, str(value)))]


def video_arguments(target: str, o: Options) -> list[str]:
    if o.copy:
        return ["-c", "copy"]
    crf = str(DEFAULT_CRF.get(target, 23) if o.crf is None else o.crf)
    out = [crf if x == "{crf}" else x for x in VIDEO_CODECS[target]]
    if target in ("mp4", "mov") and o.faststart:
        out += ["-movflags", "+faststart"]
    if o.size:
        out += ["-vf", "scale={}:{}".format(*o.size)]
    return out if o.fps is None else [*out, "-r", f"{o.fps:g}"]


def still_arguments(target: str, o: Options) -> list[str]:
    """The picture at one second; a GIF shows the first five seconds, ten pictures a second."""
    scale = "scale={}:{}".format(*o.size) if o.size else None
    if target == "gif":
        return ["-vf", ",".join(["fps=10", *([f"{scale}:flags=lanczos"] if scale else []), PALETTE]), "-t", "5"]
    return ["-ss", "00:00:01.000", "-vframes", "1", *(["-vf", scale] if scale else [])]


def arguments(source_kind: str, target: str, target_kind: str, o: Options) -> list[str]:
    """Encoder arguments between input and output, by the kinds (image, audio, video) of both."""
    makers = {("audio", "audio"): audio_arguments, ("video", "audio"): audio_arguments, ("video", "video"): video_arguments, ("video", "image"): still_arguments}
    make = makers.get((source_kind, target_kind))
    known = {"audio": AUDIO_CODECS, "video": VIDEO_CODECS}.get(target_kind)
    if make is None or (known is not None and target not in known):
        raise Malformed("UnsupportedFormat", f"Unsupported media format: {source_kind} to {target}")
    return make(target, o)


def convert(content: bytes, source: str, source_kind: str, target: str, target_kind: str, o: Options = Options(), seconds: int = 600, tool: str = ENCODER) -> bytes:
    """The converted bytes. No encoder on the machine, an encoder that fails and one that takes longer than
    `seconds` are typed errors; the files of a run go in any case."""
    args = arguments(source_kind, target, target_kind, o)
    program = find_tool(tool)
    if program is None:
        raise Malformed("UnsupportedFormat", f"Unsupported media format: writing {target} takes {tool}, which this machine has not")
    with tempfile.TemporaryDirectory(prefix="blobscope-") as folder:
        given, made = f"{folder}/in.{source}", f"{folder}/out.{target}"
        with open(given, "wb") as f:
            f.write(content)
        try:
            done = subprocess.run([program, "-v", "error", "-i", given, *args, "-y", made], capture_output=True, timeout=seconds, stdin=subprocess.DEVNULL)
        except subprocess.TimeoutExpired:
            raise Malformed("ConversionError", f"Conversion error: {tool} took longer than {seconds} seconds") from None
        if done.returncode or not os.path.exists(made):
            raise Malformed("ConversionError", f"Conversion error: {tool}: {done.stderr.decode('utf-8', 'replace').strip()[:500]}")
        with open(made, "rb") as f:
            return f.read()
