"""Imported by Python at its start where this folder is on its path: by the daemon that forks Spark's Python workers.

What the daemon has imported, all workers of a machine share; otherwise each would hold its own copy of these libraries.
"""

import contextlib
import gc
import sys

if "pyspark.daemon" in sys.orig_argv:
    with contextlib.suppress(ImportError):
        import numpy
        import pandas
        import pyarrow
        import pyarrow.compute  # noqa: F401
    gc.collect()
    gc.freeze()
