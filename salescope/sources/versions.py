"""Versions of a stored table: staged write, one atomic switch, readers undisturbed.

A store folder holds version folders and a folder of published names::

    store/v00000001-3f2a91c0/...        complete, older
    store/v00000002-77b1d0e4/...        complete, current
    store/_published/v00000001-3f2a91c0
    store/_published/v00000002-77b1d0e4

A refresh writes a new version folder, and only when that write is committed
creates the empty file of its name under ``_published``; the highest published
name is the current version. Creating an empty file is one atomic step on every
file system, object stores included: nothing is renamed or overwritten. So a reader
during a refresh, or after a write that was killed, sees the old version whole, and a
frame that was planned before the switch reads its own version to the end, as long
as that is kept.

Two refreshes at a time both end complete; the higher name is current.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

PUBLISHED = "_published"
#: Complete versions kept by a refresh: the current one and the one before it,
#: which readers may still be on.
KEEP = 2
_NAME = re.compile(r"v(\d{8,})-[0-9a-f]{8}(\.\w+)?")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Version names in ``folder``, in order of their numbers; the listing is of a few
    versions, not of data."""
    place, system = _place(spark, folder)
    if not system.exists(place):
        return []
    found = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted((n for n in found if _NAME.fullmatch(n)), key=lambda n: (int(_NAME.fullmatch(n)[1]), n))


def published_versions(spark: SparkSession, store: str) -> list[str]:
    """Names of the complete versions, the current one last."""
    return _names(spark, f"{store.rstrip('/')}/{PUBLISHED}")


def current_version(spark: SparkSession, store: str) -> str | None:
    """Folder of the current version; None where ``store`` has no versions (it may be
    a plain table, or its first write did not end)."""
    names = published_versions(spark, store)
    return f"{store.rstrip('/')}/{names[-1]}" if names else None


def refresh(spark: SparkSession, store: str, write: Callable[[str], None], tag: str = "", keep: int = KEEP) -> str:
    """Let ``write`` fill a new version folder, publish it, and remove complete
    versions beyond the ``keep`` newest; returns the new folder.

    ``tag`` (letters, digits and ``_``) becomes the end of the version's name. If
    ``write`` fails nothing is published; what it left stays until
    :func:`clear_unpublished`.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    if tag and not re.fullmatch(r"\w+", tag):
        raise ValueError(f"tag {tag!r} holds more than letters, digits and _")
    store = store.rstrip("/")
    taken = {*_names(spark, store), *published_versions(spark, store)}
    number = 1 + max((int(_NAME.fullmatch(n)[1]) for n in taken), default=0)
    name = f"v{number:08d}-{uuid.uuid4().hex[:8]}" + (f".{tag}" if tag else "")
    write(f"{store}/{name}")
    mark, system = _place(spark, f"{store}/{PUBLISHED}/{name}")
    if not system.createNewFile(mark):
        raise FileExistsError(f"{store}/{PUBLISHED}/{name}")
    for old in published_versions(spark, store)[:-keep]:
        _withdraw(spark, store, old)
    return f"{store}/{name}"


def _withdraw(spark: SparkSession, store: str, name: str) -> None:
    """The name goes first, so that no reader finds a half-removed version."""
    for path in (f"{store}/{PUBLISHED}/{name}", f"{store}/{name}"):
        place, system = _place(spark, path)
        system.delete(place, True)


def roll_back(spark: SparkSession, store: str) -> str:
    """Withdraw the current version; the one before it is current again."""
    store = store.rstrip("/")
    names = published_versions(spark, store)
    if len(names) < 2:
        raise ValueError(f"{store} keeps no version before its current one")
    _withdraw(spark, store, names[-1])
    return f"{store}/{names[-2]}"


def clear_unpublished(spark: SparkSession, store: str) -> int:
    """Remove what killed writes left; returns how many folders. Call it only while no
    refresh runs: a version that is being written is not published either."""
    store = store.rstrip("/")
    left = sorted(set(_names(spark, store)) - set(published_versions(spark, store)))
    for name in left:
        place, system = _place(spark, f"{store}/{name}")
        system.delete(place, True)
    return len(left)
