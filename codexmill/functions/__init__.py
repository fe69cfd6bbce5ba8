"""Part of the codexmill analytics engine."""
