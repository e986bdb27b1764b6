"""Document analytics on Spark: retrieval, scoring, evaluation and corpus upkeep as DataFrame plans."""
