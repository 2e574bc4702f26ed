"""Record aggregation on Spark: versioned store, postings, relations and queries over them."""
