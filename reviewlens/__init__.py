"""Review-helpfulness analytics on Spark.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for the scalar helpers in :mod:`reviewlens.functions`) and is built
from Spark built-ins, joins, aggregates and windows, so Catalyst plans the whole
flow and the work runs on the executors.
"""

__version__ = "0.1.0"
