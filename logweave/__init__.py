"""Log and trace analytics on Spark."""
