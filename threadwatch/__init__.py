"""threadwatch: comment-thread risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus keyword parameters) and returns a
DataFrame; nothing iterates rows on the driver.  Sub-packages:

* ``sources``   – readers for the landed corpus (CSV / JSON trees, API pages) and sinks
* ``functions`` – column expressions (text cleaning, label / topic parsing, scores)
* ``operators`` – table operators (threads, privacy, gold, risk, metrics, figures)
* ``plans``     – the driver-table adapters and the registered queries
* ``streaming`` – incremental (Structured Streaming) variants of the batch jobs
"""

__version__ = "0.1.0"
