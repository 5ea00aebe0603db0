"""Stateful operators for Structured Streaming and their batch forms."""
