"""spectrail: a Spark-native engine for molecule-resolved spectral records."""

__version__ = "0.1.0"
