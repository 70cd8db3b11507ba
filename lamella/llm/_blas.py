"""Matrix products of a task on the one core that the task was given."""

from __future__ import annotations

import ctypes
import glob
import os

import numpy as np


def one_thread() -> None:
    """Keep numpy's own OpenBLAS to one thread: waiting threads would take the cores of other tasks. Other builds stay as they are."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
