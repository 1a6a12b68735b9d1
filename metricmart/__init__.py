"""metricmart: metric histories, decision support and text statistics as PySpark DataFrame operators."""
