"""Send small helper functions to the workers by value.

Without this the executors would need this package on their own path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
