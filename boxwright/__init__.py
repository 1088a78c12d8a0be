"""Box-event analytics on Spark: detections in, events, identities, masks and metrics out."""
