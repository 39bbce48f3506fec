"""Structured Streaming forms of the tracker."""
