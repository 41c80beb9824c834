"""siftline: document evidence analytics on Spark."""
