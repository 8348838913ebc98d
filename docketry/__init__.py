"""Document and case analytics on Spark: catalogue, search, text, tree, sheet and streaming operators."""
