"""laneflow: lane/section speed analytics for vehicle trajectories, written as Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``) that declares a
plan; the caller decides when, and on what cluster, it runs. Where an operator writes an
intermediate table first, and so starts a job when it is called, its docstring says so.
"""

from laneflow.config import EXPERIMENTS, SampleConfig, SiteConfig, WindowConfig

__all__ = ["EXPERIMENTS", "SampleConfig", "SiteConfig", "WindowConfig"]
