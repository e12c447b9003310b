"""Real-time forecast evaluation on Spark: vintages, nested validation, losses, comparison and inference as DataFrame plans."""
