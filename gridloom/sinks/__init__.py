"""Sinks: frames as CSV, XLSX and ODS documents.

Executors encode rows into text; the driver only streams the pieces, in order,
into one file. CSV can also be written in parts, with nothing on the driver.
"""
