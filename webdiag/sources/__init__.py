"""Inputs: driver tables, capture payloads, adapters."""
