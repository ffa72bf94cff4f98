"""PySpark-native analytics for calibrated sensor-image stacks."""
