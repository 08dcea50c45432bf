"""sableframe: a PySpark-native engine for finding and redacting personal data in text collections."""
