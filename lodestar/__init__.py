"""lodestar: graph-and-evidence analytics, declared as Spark plans."""
