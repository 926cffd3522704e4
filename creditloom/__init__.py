"""Credit analytics on Spark: raw lender files to features, scores and explanations."""
