"""An inventory of cryptography in source trees, as Spark jobs."""
