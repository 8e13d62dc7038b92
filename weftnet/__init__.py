"""A PySpark-native engine for labelled tensors and tensor networks."""
