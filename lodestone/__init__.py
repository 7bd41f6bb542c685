"""A PySpark-native analytics engine for long-lived evidence and conversation memory."""
