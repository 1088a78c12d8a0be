"""Part of the box-event analytics engine."""
