"""ampmill: a PySpark-native analytics engine for power-transistor catalogues, datasheet facts and loss models."""
