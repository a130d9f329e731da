"""Evidence analytics and corpus preparation as Spark DataFrame plans."""
