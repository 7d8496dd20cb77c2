"""yieldlens — Spark-native analytics for manufacturing test results.

Every public function is DataFrame -> DataFrame (or returns a Column).
Nothing collects to the driver; "now" is always an explicit ``asof``.
"""

__version__ = "0.1.0"
