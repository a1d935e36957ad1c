"""Plain DuckDB SQL for every report, written from its definition.

The statements join and aggregate literally (left joins that multiply rows,
NOT IN, NOT EXISTS, quantile_cont), so that they check the rewritten Spark
plans rather than repeat them.
"""

from .statements import statements

__all__ = ["statements"]
