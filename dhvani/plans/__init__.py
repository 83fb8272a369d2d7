"""End-to-end plans (the reference's scripts as Spark jobs) and the query catalog."""
