"""monthlens: dated text -> period features -> outcome models, as Spark jobs.

Layers
------
sources    derived input views (articles, vectors, macro, topics) and file IO
functions  column expressions (tokeniser, stop words, reply parsing) and small
           numeric helpers used inside grouped Arrow tasks
operators  distributed building blocks (vectorise, moments, Lasso, OLS, Ridge,
           time-series windows, batched inference, audits)
plans      composite analyses built from the operators
streaming  incremental append / resume of batched work
"""

from monthlens.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "ensure_checkpoint_dir"]
