"""lodestone: document-corpus retrieval and analytics as Spark DataFrame plans."""
