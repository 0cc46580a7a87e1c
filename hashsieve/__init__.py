"""hashsieve: near-duplicate detection and asset analytics as Spark jobs.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame
jobs), ``sources`` (stores and scans), ``streaming`` (micro-batch jobs),
``plans`` (registered queries on the driver tables with their SQL oracles).
"""

__version__ = "0.1.0"
