"""lakesieve: record normalisation, deduplication, scoring and training-data preparation on Spark.

The package is a library of functions over Columns and DataFrames:

* ``functions``  record-local Column expressions (normalisers, hashes, parsers, detectors)
* ``operators``  DataFrame -> DataFrame operators (dedupe, matching, folders, media, usage, redelivery)
* ``sources``    readers and writers
* ``streaming``  stateful Structured Streaming operators
* ``plans``      ready-made query plans over the test tables
* ``llm``        training-data operators; nothing outside that subpackage imports it
"""

__version__ = "0.1.0"
