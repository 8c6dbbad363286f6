"""Steps of a long run: logged, and named in what goes wrong."""

from __future__ import annotations

import contextlib
import logging
import time
from collections.abc import Iterator

log = logging.getLogger("strata")


def verbose(on: bool = True) -> None:
    """Show steps as they end; calling it again adds nothing."""
    log.setLevel(logging.INFO if on else logging.WARNING)
    if on and not log.handlers:
        log.addHandler(logging.StreamHandler())


@contextlib.contextmanager
def step(name: str) -> Iterator[None]:
    began = time.perf_counter()
    try:
        yield
    except MemoryError as e:
        e.add_note(f"in {name}: a dense matrix did not fit; fewer nodes, or the iterative similarity")
        raise
    except Exception as e:
        hint = "; an executor was lost, perhaps for memory: more partitions or more memory for each" if "ExecutorLost" in str(e) or "exited" in str(e) else ""
        e.add_note(f"in {name}{hint}")
        raise
    log.info("%s: %.1f s", name, time.perf_counter() - began)
