"""Readers and writers: tables, delimited text, sectioned text, JDBC."""
