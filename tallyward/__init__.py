"""Area-level incident analytics as Spark DataFrame jobs.

Layers, lowest first: ``functions`` (column expressions), ``sources`` (scans,
sinks, staged tables), ``operators`` (DataFrame -> DataFrame building blocks),
``plans`` (the analyses built from them) and ``catalog`` (named queries over the
test tables with their SQL counterparts).
"""
