"""corvane: retrieval, knowledge-graph and policy analytics as Spark DataFrame plans."""
