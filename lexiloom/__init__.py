"""lexiloom: Spark-native preparation and measurement of sequence-labelled text corpora."""
