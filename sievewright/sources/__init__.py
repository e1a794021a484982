"""Payloads decoded into result rows, pages into text, and result sinks."""
