"""namelens: personal-name analytics on Spark, with no per-row Python."""
