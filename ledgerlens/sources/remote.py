"""Files and feeds from elsewhere, landed as files for Spark to read. Every function takes the opener that it calls."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO
from urllib.request import urlopen

Opener = Callable[[str], BinaryIO]
CHUNK = 1 << 20


def _open(url: str) -> BinaryIO:
    return urlopen(url, timeout=60)


def resources(catalogue: str, part: str = "", opener: Opener = _open) -> list[dict[str, str]]:
    """[{name, url}] of the CSV files of a data catalogue's package whose name holds `part`, by name.

    LookupError if there is none; KeyError if the answer is no package.
    """
    with opener(catalogue) as f:
        found = json.load(f)["result"]["resources"]
    got = sorted(({"name": r["name"], "url": r["url"]} for r in found if r["url"].lower().endswith(".csv") and part.lower() in r["name"].lower()), key=lambda r: r["name"])
    if not got:
        raise LookupError(f"no CSV file with {part!r} in its name")
    return got


def download(url: str, path: str, opener: Opener = _open) -> int:
    """Bytes written to path, a piece at a time; path appears only when all of it is there."""
    aside, n = f"{path}.{os.getpid()}.part", 0
    with opener(url) as f, open(aside, "wb") as out:
        while piece := f.read(CHUNK):
            n += out.write(piece)
    os.replace(aside, path)
    return n


def landed(files: list[dict[str, str]], folder: str, opener: Opener = _open) -> list[str]:
    """Paths of the files in a folder; only those that aren't there yet are downloaded."""
    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, os.path.basename(r["url"])) for r in files]
    for r, p in zip(files, paths):
        if not os.path.exists(p):
            download(r["url"], p, opener)
    return paths


def fetched(url: str, opener: Opener = _open, tries: int = 3, wait: float = 1.0) -> Any:
    """The JSON behind a URL. A failure is tried again after wait, twice wait, ...; RuntimeError after the last try."""
    for i in range(tries):
        try:
            with opener(url) as f:
                return json.load(f)
        except (OSError, ValueError) as e:
            if i == tries - 1:
                raise RuntimeError(f"{url}: {e}") from e
            time.sleep(wait * 2**i)


def pages(url_of: Callable[[int], str], since: int, size: int = 250, most: int = 2000, opener: Opener = _open, **options) -> Iterator[list[dict]]:
    """Pages of a feed that gives its newest records first, each without records dated (epoch seconds) before `since`.

    Ends at an empty page, at a short one, after `most` pages, or when a whole page is too old.
    """
    for n in range(most):
        got = fetched(url_of(n), opener, **options).get("results") or []
        fresh = [r for r in got if int(r.get("date") or 0) >= since]
        if fresh:
            yield fresh
        if not fresh or len(got) < size:
            return


def land_pages(feed: Iterator[list[dict]], folder: str) -> int:
    """Records written to a folder, a file of JSON lines for each page, so that a stream on the folder takes each page once."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for i, page in enumerate(feed):
        path = os.path.join(folder, f"page-{time.time_ns()}-{i:05d}.json")
        with open(f"{path}.part", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in page)
        os.replace(f"{path}.part", path)
        n += len(page)
    return n
