"""The canonical label form for the driver's own small tables."""

from __future__ import annotations

import re
import unicodedata


def canonical(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^A-Z0-9]+", " ", bare.upper()).strip()
