"""PySpark-native engine for preparing, mining and monitoring tabular, event and text data."""
