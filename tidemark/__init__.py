"""Evidence-continuity analytics as Spark jobs: is a per-source event log complete, ordered and unaltered?"""

__version__ = "0.1.0"
