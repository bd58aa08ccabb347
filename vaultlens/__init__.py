"""PySpark-native analytics over collections of binary resource archives."""
