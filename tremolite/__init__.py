"""Response analytics on Spark: entity models, recorders, series, reliability, accumulators and graphs as DataFrame plans."""
