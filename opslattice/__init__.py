"""Log, topology and network-security analytics as Spark DataFrame jobs."""
