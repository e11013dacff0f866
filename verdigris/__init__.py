"""Typed-answer analytics over document collections, expressed as Spark plans."""
