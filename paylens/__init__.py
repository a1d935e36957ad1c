"""Payment-transaction analytics expressed as Spark DataFrame plans."""
