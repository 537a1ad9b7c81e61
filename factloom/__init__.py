"""factloom: analytics over facts, conversations and documents on Spark."""
