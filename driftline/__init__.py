"""Change-data sync and analytics on Spark DataFrames."""

from driftline.config import SyncTask

__all__ = ["SyncTask"]
