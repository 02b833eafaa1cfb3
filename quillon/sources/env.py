"""Settings from a .env file (S7): KEY=VALUE, # comments, quotes dropped; what the environment has already wins."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from pathlib import Path


def load(path: str | Path = ".env", env: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    found: dict[str, str] = {}
    file = Path(path)
    for row in file.read_text("utf-8").splitlines() if file.exists() else ():
        key, sign, value = row.strip().partition("=")
        if sign and key.strip() and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("\"'")
    for key, value in found.items():
        env.setdefault(key, value)
    return found


def api_key(given: str | None = None, env: MutableMapping[str, str] = os.environ) -> str | None:
    return given or env.get("GOOGLE_API_KEY") or env.get("GEMINI_API_KEY")
