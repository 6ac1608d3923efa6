"""Windows over events that run on streams and tables alike (not among the survey's operators)."""
