"""Support-mail analytics as DataFrame operators on Spark."""
