"""Document retrieval on Spark: index pages, retrieve passages, answer and score tables of questions."""
