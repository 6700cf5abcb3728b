"""Stream analytics on PySpark: label spaces, schedules, ordered streams and their test-then-train evaluation."""
