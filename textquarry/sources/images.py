"""Images inside pages: inline data, identity, dimensions, markers."""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row

from textquarry.functions.text import one_line

# File name extensions of image types.
EXTENSIONS = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/svg+xml": "svg"}
_DATA = re.compile(r"data:(image/[A-Za-z0-9.+-]+);base64")
#: JPEG markers that start a frame: SOF0 to SOF15 without DHT, JPG and DAC
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def dimensions(data: bytes, mime: str) -> tuple[int | None, int | None]:
    """Width and height from the header of a PNG, JPEG, WebP or GIF; None where it can't be read."""
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    big = lambda a, b: int.from_bytes(data[a:b], "big")
    n = len(data)
    if mime == "image/png" and data[:8] == b"\x89PNG\r\n\x1a\n" and n >= 24:
        return big(16, 20), big(20, 24)
    if mime == "image/gif" and data[:6] in (b"GIF87a", b"GIF89a") and n >= 10:
        return little(6, 8), little(8, 10)
    if mime == "image/webp" and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = data[12:16]
        if kind == b"VP8X" and n >= 30:
            return little(24, 27) + 1, little(27, 30) + 1
        if kind == b"VP8 " and n >= 30:
            return little(26, 28) & 0x3FFF, little(28, 30) & 0x3FFF
        if kind == b"VP8L" and n >= 25:
            return (little(21, 25) & 0x3FFF) + 1, (little(21, 25) >> 14 & 0x3FFF) + 1
    if mime in ("image/jpeg", "image/jpg"):
        at = 2
        while at + 9 < n:
            if data[at] != 0xFF:
                at += 1
            elif data[at + 1] in _FRAMES:
                return big(at + 7, at + 9), big(at + 5, at + 7)
            else:
                at += 2 + big(at + 2, at + 4)
    return None, None


def inline(src: str, source_path: str, index: int, folder: str) -> tuple[dict, bytes] | None:
    """The record and the bytes of an image given as a data URI; None for anything else."""
    header, comma, payload = src.partition(",")
    kind = _DATA.match(header)
    if not comma or not kind:
        return None
    mime = kind.group(1).lower()
    try:
        data = base64.b64decode(payload, validate=False)
    except (binascii.Error, ValueError):
        return None
    digest = hashlib.sha256(f"{source_path}:{index}:{payload[:256]}".encode()).hexdigest()[:16]
    place = hashlib.sha256(source_path.encode()).hexdigest()[:12]
    width, height = dimensions(data, mime)
    record = {
        "local_path": f"{folder}/{place}/image-{index:04d}-{digest}.{EXTENSIONS.get(mime, 'bin')}",
        "mime_type": mime,
        "extracted": True,
        "sha256": hashlib.sha256(data).hexdigest(),
        "size_bytes": len(data),
        "width": width,
        "height": height,
    }
    return record, data


def label(image: dict) -> str:
    return image["alt"] or image["title"] or f"image-{image['index']}"


def marker(image: dict) -> str:
    """The line that stands for an image in the text of its page."""
    parts = [f"[Image {image['index']}: {label(image)}]"]
    if image["local_path"]:
        parts.append(f"path={image['local_path']}")
    elif image["src"] != "[inline-image]":
        parts.append(f"src={image['src']}")
    if image["mime_type"]:
        parts.append(f"mime={image['mime_type']}")
    if image["width"] and image["height"]:
        parts.append(f"size={image['width']}x{image['height']}")
    for name, key, limit in (("description", "description", 160), ("ocr", "ocr_text", 200)):
        if image[key]:
            parts.append(f"{name}={one_line(image[key], limit)}")
    return " ".join(parts)


def empty(index: int, src: str, alt: str, title: str) -> dict:
    return {
        "index": index, "src": src, "alt": alt, "title": title, "local_path": "", "mime_type": "", "extracted": False,
        "sha256": "", "size_bytes": 0, "width": None, "height": None, "ocr_text": "", "description": "",
    }


def _file_system(root: str):
    """(file system, folder) of ``root``, a local path or any address that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def write(files: DataFrame, root: str) -> None:
    """Write (local_path, content) below ``root``, from the tasks; a file that is there stays."""

    def put(rows: Iterator[Row]) -> None:
        system, folder = _file_system(root)
        for r in rows:
            path = f"{folder}/{r['local_path']}"
            if not system.get_file_info(path).size:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(bytes(r["content"]))

    files.select("local_path", "content").foreachPartition(put)


def delete(files: DataFrame, root: str) -> None:
    """Delete (local_path) below ``root``, from the tasks; a file that is gone already is no error."""

    def drop(rows: Iterator[Row]) -> None:
        system, folder = _file_system(root)
        for r in rows:
            try:
                system.delete_file(f"{folder}/{r['local_path']}")
            except FileNotFoundError:
                pass

    files.select("local_path").foreachPartition(drop)
