"""Building and auditing datasets of structured records on Spark: matching, flags, fixes, statistics, releases."""
