"""A PySpark-native engine for scoring groups of logical clauses and auditing the data around them."""
