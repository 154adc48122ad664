"""Quillmark: a Spark-native engine for turning source documents into ranked, evidence-checked reports."""

__version__ = "0.1.0"
