"""Named pipelines, and the library's own queries with their SQL twins."""

from .pipeline import Launcher, Options, Pipeline, endpoint, launch, launch_and_wait, merged, name

__all__ = ["Launcher", "Options", "Pipeline", "endpoint", "launch", "launch_and_wait", "merged", "name"]
