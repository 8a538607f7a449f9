"""Extraction of configuration reads from JavaScript and TypeScript text."""
