"""rankweave: ranking and recommendation analytics as Spark plans."""
