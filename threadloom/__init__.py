"""threadloom: mailing-list and patch-series analytics as Spark plans."""
