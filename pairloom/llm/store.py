"""Intermediate tables in the folder that the cluster shares: the library's own."""

from ..sources.store import materialize, release, shared_dir

__all__ = ["materialize", "release", "shared_dir"]
