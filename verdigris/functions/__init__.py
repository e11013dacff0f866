"""Part of verdigris."""
