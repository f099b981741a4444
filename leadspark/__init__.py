"""A PySpark-native engine for business-lead data: extract, clean, resolve, validate, enrich, score, serve and export."""
