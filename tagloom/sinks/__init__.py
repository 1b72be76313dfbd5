"""Exports of statistics, clusters and files."""
