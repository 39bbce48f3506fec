"""Readers that turn raw recorder files into tables."""
