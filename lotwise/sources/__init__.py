"""Readers for messy exports, import profiles and result sinks."""
