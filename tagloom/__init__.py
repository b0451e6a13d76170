"""Detection, tracking, label and text analytics on Spark."""
