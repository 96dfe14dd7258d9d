"""Landing of remote files, before Spark reads them."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Callable


def cached(url: str, path: str, fetch: Callable = urllib.request.urlopen) -> str:
    """path, where a copy of url is; nothing is fetched if it is there and not empty. A copy is whole or absent."""
    if os.path.exists(path) and os.path.getsize(path) > 0:
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.part"
    with fetch(url) as source, open(part, "wb") as out:
        shutil.copyfileobj(source, out)
    os.replace(part, path)
    return path
