"""shelfcast — retail demand analytics as plain PySpark DataFrame jobs.

Every public function takes and returns DataFrames (or fitted MLlib models),
so Catalyst sees one declarative plan per job: scans are pruned and filtered
at the parquet reader, aggregations run partial + final, and join strategies
are chosen at run time by adaptive query execution from measured sizes.

Modules
-------
sources    readers for the driver tables, the derived order/view summaries,
           LIBSVM files, and the feature-table sink (keyed upsert).
functions  column expressions (scores, price buckets, flags, splits,
           cross-engine rounding) and the distributed global ranking.
operators  the relational and ML building blocks (cleansing, aggregates,
           joins, rollups, indexing, vectors, learners, metrics).
plans      end-to-end jobs composed from the operators.
fixed      input and output contracts of the jobs (column lists, types, keys).
"""

from shelfcast.session import get_session, shared_dir, materialize

__all__ = ["get_session", "shared_dir", "materialize"]
