"""folioflow: a PySpark-native analytics engine for career documents and job descriptions."""
