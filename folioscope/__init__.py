"""Document and knowledge analytics expressed as Spark DataFrame programs."""
