"""seedloom: locating short sequences inside large reference sequences, on Spark."""
