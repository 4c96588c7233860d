"""Structured Streaming form of the response scoring.

The reference reads responses from files after generation; here new
response files landing in a folder are scored as they arrive.
"""
