"""Mining of click sequences from session logs with Spark."""

from trailmine.params import SequenceParams
from trailmine.plans.jobs import JOBS, Job, run

__all__ = ["JOBS", "Job", "SequenceParams", "run"]
