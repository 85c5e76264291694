"""Clinical-record analytics as DataFrame-to-DataFrame operators on Spark."""
