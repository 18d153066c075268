"""kodex: a Spark-native analytics engine for citation graphs over versioned legal text."""
