"""clonelake: a PySpark-native engine for T-cell-receptor repertoires and the data preparation around them."""

__version__ = "0.1.0"
