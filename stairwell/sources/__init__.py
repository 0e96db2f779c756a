"""Readers.  Every schema is stated, so no reader scans its input to infer one."""
