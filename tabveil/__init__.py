"""tabveil: prepare, protect, score and rank private tables with Spark DataFrames."""
