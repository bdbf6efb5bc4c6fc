"""Market-bar and daily-panel analytics as plain PySpark DataFrame operators."""
