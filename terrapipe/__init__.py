"""terrapipe: a PySpark-native engine for weather-driven advisories and corpus preparation."""
