"""Graphs over tables and scripts, and scripts from graphs."""
