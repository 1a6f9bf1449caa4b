"""marlstone: a PySpark-native analytics engine for scored code corpora."""
