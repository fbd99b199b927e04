"""Wiki-dump analytics on Spark: page tables in, tables out."""
