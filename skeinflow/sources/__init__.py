"""Readers and writers of the text formats that reads, graphs and alignments come in."""
