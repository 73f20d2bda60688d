"""Saving a JSON file whole or not at all, and never over a change that its writer hasn't seen."""

from __future__ import annotations

import json
import os
import stat
import uuid
from typing import Any

from .errors import ExtractionError


def save_json(path: str, value: Any, seen: bytes | None = None, max_bytes: int | None = None) -> bytes:
    """Writes value to path and returns the bytes written.

    seen: the bytes that the caller read from path, or None for a file that must not exist yet. A file that holds
    anything else, a symbolic link, or a save in progress is an error and stays as it is. A new file gets mode 0600, an
    old one keeps its mode. A lock that a crashed writer left has to be removed by hand.
    """
    data = (json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()
    if max_bytes is not None and len(data) > max_bytes:
        raise ExtractionError(f"{path}: over {max_bytes} bytes")
    folder, name = os.path.split(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    lock, draft = os.path.join(folder, f".{name}.saving"), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")

    def unchanged() -> None:
        if os.path.islink(path):
            raise ExtractionError(f"{path}: is a symbolic link")
        if seen is not None:
            with open(path, "rb") as f:
                if f.read() != seen:
                    raise ExtractionError(f"{path}: has changed since it was read")

    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
    except FileExistsError as e:
        raise ExtractionError(f"{path}: is being saved by another writer ({lock})") from e
    try:
        unchanged()
        mode = 0o600 if seen is None else stat.S_IMODE(os.stat(path).st_mode)
        with open(draft, "xb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(draft, mode)
        unchanged()
        if seen is None:
            try:
                os.link(draft, path)  # fails where the file has come into being meanwhile
            except FileExistsError as e:
                raise ExtractionError(f"{path}: exists already") from e
        else:
            os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.unlink(draft)
        os.unlink(lock)
    return data
