"""tilescope: evaluation of learned representations of gridded imagery on Spark."""
