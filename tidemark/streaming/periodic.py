"""Periodic checkpoints: sign the audit log's state every so often, and the job text for an external scheduler."""

from __future__ import annotations

import threading
from xml.sax.saxutils import escape

from tidemark.functions.scalars import LEAST_INTERVAL

DEFAULT_INTERVAL = 300


def checked_interval(secs: int) -> int:
    return max(LEAST_INTERVAL, secs)


def anchor_every(warehouse, folder: str, key: tuple[bytes, str], secs: int = DEFAULT_INTERVAL, stop: threading.Event | None = None, least: int = LEAST_INTERVAL) -> int:
    """Anchor now and after every interval until stop is set; how many anchors were made."""
    stop, made = stop or threading.Event(), 0
    while not stop.is_set():
        warehouse.anchor(folder, key)
        made += 1
        stop.wait(max(least, secs))
    return made


def agent_text(label: str, command: list[str], secs: int = DEFAULT_INTERVAL) -> str:
    """A property list for a scheduler that reads those; all values are escaped."""
    quote = lambda s: escape(s, {'"': "&quot;", "'": "&apos;"})
    words = "".join(f"    <string>{quote(c)}</string>\n" for c in command)
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<plist version="1.0">
<dict>
  <key>Label</key>
  <string>{quote(label)}</string>
  <key>ProgramArguments</key>
  <array>
{words}  </array>
  <key>StartInterval</key>
  <integer>{checked_interval(secs)}</integer>
</dict>
</plist>
"""
