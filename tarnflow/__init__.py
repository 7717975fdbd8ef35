"""DataFrame operators for event studies, document evidence and text corpora on Spark."""
