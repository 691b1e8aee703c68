"""Readers and writers of the file layouts that the library knows."""
