"""factloom: a PySpark-native analytics engine for evidence-backed facts."""
