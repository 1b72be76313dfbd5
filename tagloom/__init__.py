"""tagloom: a Spark-native engine for tag catalogs, tag queries and near-duplicate clustering."""
