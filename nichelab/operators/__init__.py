"""Relational operators: DataFrame -> DataFrame functions without state or UDFs."""
