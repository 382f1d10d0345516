"""vantage: Spark-native model-comparison analytics.

Every operator is a function ``DataFrame -> DataFrame`` (use with
``df.transform``) or a ``Column`` helper.  All datasets live in one long
table keyed by ``dataset`` (and ``model``), so the same plan serves one
dataset or a million of them.
"""

from vantage.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
