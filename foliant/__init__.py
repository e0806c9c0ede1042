"""Book-catalogue and reading-activity analytics on Spark."""
