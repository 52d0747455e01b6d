"""Query name -> Spark function and query name -> DuckDB SQL."""

from __future__ import annotations

from hourline.plans import forecasting, labels_and_shapes, pixels_and_spine, series  # noqa: F401  (they register their queries)
from hourline.plans.registry import QUERIES, SQL  # noqa: F401
