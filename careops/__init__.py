"""careops — customer-operations analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame(s) -> DataFrame`` built from
``pyspark.sql.functions`` built-ins, so Catalyst can push filters into the
Parquet scans, prune columns and plan the shuffles.  Sub-packages:

* ``sources``   — logical relations (orders, calls, chats, ledger, ...) and
                  how they are derived from the shared test tables.
* ``functions`` — column expressions and small DataFrame helpers shared by
                  the operators (window predicates, commission parsing,
                  row replication, nearest match).
* ``operators`` — the user-level operators (retention, contact extracts,
                  service metrics, alcohol split, commission, payments).
* ``plans``     — end-to-end compositions and the query registry used by
                  ``__spark_entry__``.
* ``streaming`` — the stateless extracts run incrementally with Structured
                  Streaming.
"""

from careops.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
