"""Typed tables and the words their status columns may hold."""
