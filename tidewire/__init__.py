"""News-archive and deal analytics, expressed as Spark DataFrame operators."""
