"""millrace: dataset-readiness analytics as Spark DataFrame plans.

The package is pickled by value into Python tasks, so executors need PySpark,
pyarrow and numpy but no installed copy of the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
