"""heddle: a Spark-native engine for transcripts, knowledge hygiene and source inventories."""
