"""findlake: search and maintain large catalogs of files and folders on Spark.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or takes a
few DataFrames and returns one), so it composes with ``df.transform(...)``.
Most are one lazy plan; those that measure a batch before a broadcast, number
rows or settle rivals in rounds also run small jobs while they are called.
"""

from findlake.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
