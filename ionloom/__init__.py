"""ionloom: mass-spectrometry-imaging analytics expressed as Spark DataFrame jobs."""
