"""authorloom: incremental author disambiguation and corpus analytics on Spark."""
