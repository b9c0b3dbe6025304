"""slatework: building-level geospatial and table operators expressed as Spark plans.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``sources`` (readers and writers), ``plans`` (named queries with
their SQL oracles), ``streaming`` (Structured Streaming forms).
"""

__version__ = "0.1.0"
