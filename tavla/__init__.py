"""tavla: document-comparison analytics on Spark DataFrames."""
