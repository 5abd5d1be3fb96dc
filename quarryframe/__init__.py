"""quarryframe: a PySpark-native engine for building, labelling and evaluating frame-level datasets."""
