"""docloom: a Spark-native store and query engine for schemaless JSON documents."""
