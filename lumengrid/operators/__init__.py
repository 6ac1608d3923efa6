"""Composable operators."""
