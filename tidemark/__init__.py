"""Account-health analytics over monthly account snapshots, as Spark DataFrame plans."""
