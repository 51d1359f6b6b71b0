"""Training-data production, curation and valuation as Spark jobs."""
