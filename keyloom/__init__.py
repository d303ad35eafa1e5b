"""Typed-keyspace analytics on Spark: every key-value command as a set-oriented DataFrame operator."""
