"""Readers and writers of genomic files. All paths are Hadoop paths; files may be gzipped where the format is text."""
