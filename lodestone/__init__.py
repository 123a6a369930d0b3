"""lodestone: memory retrieval, feedback analytics and corpus preparation as Spark DataFrame plans."""
