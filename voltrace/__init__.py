"""voltrace: a PySpark-native engine for volatility, risk and corpus analytics."""
