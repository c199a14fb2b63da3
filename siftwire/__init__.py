"""Item intelligence on Spark: normalise, de-duplicate, score, match, reconcile and digest items."""
