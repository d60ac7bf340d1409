"""Document analytics on Spark: structured legal text, comparison, graphs and statistics."""
