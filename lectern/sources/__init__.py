"""Readers: driver tables, parallel CSV/TSV corpora and audio folders."""
