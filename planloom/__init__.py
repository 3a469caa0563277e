"""planloom: a PySpark-native engine for typed programs, plans and the data around them."""
