"""Inkstone: a Spark-native engine for analysing interface source code and design tokens."""

__version__ = "0.1.0"
