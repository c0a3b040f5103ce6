"""Document-reconciliation analytics expressed as Spark DataFrame plans."""
