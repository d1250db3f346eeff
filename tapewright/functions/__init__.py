"""Part of tapewright."""
