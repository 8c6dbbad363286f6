"""Dense linear algebra beside a busy JVM: one thread, as spinning threads of the library wait for each other there."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import glob
import os
from collections.abc import Iterator

import numpy as np


@functools.cache
def _library():
    """Getter and setter of the thread count of NumPy's bundled OpenBLAS, or None."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for prefix, suffix in (("scipy_", "64_"), ("scipy_", ""), ("", "64_"), ("", "")):
            with contextlib.suppress(AttributeError):
                return getattr(lib, f"{prefix}openblas_get_num_threads{suffix}"), getattr(lib, f"{prefix}openblas_set_num_threads{suffix}")
    return None


@contextlib.contextmanager
def one_thread() -> Iterator[None]:
    found = _library()
    if found is None:
        yield
        return
    before = found[0]()
    found[1](1)
    try:
        yield
    finally:
        found[1](before)
