"""Send a function of this package to the executors by module and name.

The small closure travels by value, so workers need not have been started where the
package can be imported; the function itself is imported there, and what its module
caches lives as long as the worker. A function that makes batches gives freed memory back when it ends.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle

_ROOT = str(Path(__file__).resolve().parents[2])


def remote(module: str, name: str, *args) -> Callable:
    """A callable that imports module.name on the worker and calls it with its argument, then args."""
    root, lean = _ROOT, f"{__package__}.batches"

    def call(own):
        import importlib
        import inspect
        import sys as worker

        if root not in worker.path:
            worker.path.append(root)
        made = getattr(importlib.import_module(module), name)(own, *args)
        return importlib.import_module(lean).lean(made) if inspect.isgenerator(made) else made

    return call


cloudpickle.register_pickle_by_value(sys.modules[__name__])
