"""loomframe: tabular AutoML and data-quality jobs written for Spark.

Operators take DataFrames and return DataFrames.  Whatever is fitted (fences,
means, vocabularies) is small, bounded state; rows never pass through the
driver.
"""

from loomframe.session import build_session, materialize, scratch_path, table

__all__ = ["build_session", "materialize", "scratch_path", "table"]
