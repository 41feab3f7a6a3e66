"""Confinement of driver-side paths to allowed folders."""

from __future__ import annotations

import os


class PathEscape(ValueError):
    code = "PATH_ESCAPE"


def confined(path: str, roots: list[str]) -> str:
    """The real path, if it lies below one of the roots once all links are followed; the error names no path."""
    real = os.path.realpath(path)
    for root in roots:
        top = os.path.realpath(root)
        if real == top or real.startswith(top.rstrip(os.sep) + os.sep):
            return real
    raise PathEscape("the path is not below an allowed folder")
