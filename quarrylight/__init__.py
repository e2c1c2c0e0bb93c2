"""PySpark-native retrieval, governance and corpus analytics engine."""
