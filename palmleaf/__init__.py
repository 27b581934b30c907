"""Spark-native analytics for digitised Indic-script documents."""
