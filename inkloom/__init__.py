"""A PySpark-native engine for collections of documents: scan, normalise, shred, match, resolve, report."""
