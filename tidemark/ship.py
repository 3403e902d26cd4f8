"""Sends this package to the executors, for sessions whose workers don't have the repository on their path."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path

_sent: set[str] = set()


def ship(spark) -> None:
    """Adds the package as a zip file to the session's Python path, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidemark-"))
    archive = shutil.make_archive(str(to / "tidemark"), "zip", here.parent, here.name)
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
