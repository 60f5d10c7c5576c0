"""What the stateful streams share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle


@contextmanager
def pickled_by_value(*names: str) -> Iterator[None]:
    """Send these modules along with a processor: the driver-side state worker does
    not see shipped packages."""
    modules = [sys.modules[name] for name in names]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        yield
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)
