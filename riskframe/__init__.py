"""riskframe — card-transaction risk analytics as Spark DataFrame operators.

Every operator is a pure ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, Spark ML or (rarely) Arrow-batched pandas functions.  Sub-packages:

* ``sources``   — table scans, the stand-in views over the test tables, sinks
* ``functions`` — fixed dimension values and shared column helpers
* ``operators`` — the operator library, one module per operator family
* ``plans``     — the query catalog (Spark callable + DuckDB oracle SQL per key)
* ``streaming`` — Structured Streaming versions of the serving-side operators
"""

__version__ = "0.1.0"
